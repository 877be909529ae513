"""Further token filters and language analyzers, as Columns.

Stemming of languages other than English is by suffix lists that leave at least three letters: lighter than full stemmers,
and the same at indexing and at query time. Filters about payloads, token types and corrected offsets have no counterpart,
since tokens here are plain arrays of strings.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions import analysis as an
from lodestone.functions.analysis import Analyzer, Step, each

apostrophe = each(lambda t: F.regexp_replace(t, "['’].*$", ""))
english_possessive = each(lambda t: F.regexp_replace(t, "['’][sS]$", ""))
capitalization = each(F.initcap)
classic_filter = each(lambda t: F.when(t.rlike(r"^(\p{L}\.)+\p{L}?\.?$"), F.replace(t, F.lit("."), F.lit(""))).otherwise(F.regexp_replace(t, "['’][sS]$", "")))


def elision(articles: tuple[str, ...] = ("l", "m", "t", "qu", "n", "s", "j", "d", "c", "jusqu", "quoiqu", "lorsqu", "puisqu")) -> Step:
    return each(lambda t: F.regexp_replace(t, "(?i)^(?:" + "|".join(articles) + ")['’]", ""))


def _translate(source: str, target: str = "") -> Step:
    return each(lambda t: F.translate(t, source, target))


_ZEROS = (0x660, 0x6F0, 0x966, 0x9E6, 0xE50, 0xFF10)
decimal_digit = _translate("".join(chr(z + k) for z in _ZEROS for k in range(10)), "0123456789" * len(_ZEROS))
cjk_width = _translate("".join(chr(0xFF01 + k) for k in range(94)), "".join(chr(0x21 + k) for k in range(94)))
scandinavian_normalization = _translate("äÄöÖ", "æÆøØ")
scandinavian_folding = _translate("åÅäÄæÆöÖøØ", "aAaAaAoOoO")
arabic_normalization = _translate("أإآىةـًٌٍَُِّْ", "اااي" + "ه")
persian_normalization = _translate("يىكۀ", "ییکه")
sorani_normalization = _translate("يىك", "ییک")
hindi_normalization = _translate("ँ़", "ं")
bengali_normalization = _translate("়ঁ")
serbian_normalization = each(lambda t: F.replace(F.replace(F.replace(F.translate(F.lower(t), "абвгдђежзијклмнопрстћуфхцчшčćžšđ", "abvgddezzijklmnoprstcufhccscczsd"), F.lit("љ"), F.lit("lj")), F.lit("њ"), F.lit("nj")), F.lit("џ"), F.lit("dz")))
turkish_lowercase = each(lambda t: F.lower(F.translate(t, "İI", "iı")))
greek_lowercase = each(lambda t: F.translate(F.lower(t), "άέήίόύώϊϋΐΰς", "αεηιουωιυιυσ"))
irish_lowercase = each(lambda t: F.lower(F.regexp_replace(t, "^([nt])([AEIOUÁÉÍÓÚ])", "$1-$2")))
german_normalization = each(lambda t: F.regexp_replace(F.replace(F.translate(F.regexp_replace(t, "(?<![aeiouq])ue", "u"), "äöü", "aou"), F.lit("ß"), F.lit("ss")), "([ao])e", "$1"))


def keyword_repeat(ts: Column) -> Column:
    return F.flatten(F.transform(ts, lambda t: F.array(t, t)))


def concatenate(separator: str = " ") -> Step:
    return lambda ts: F.array(F.array_join(ts, separator))


def date_recognizer(pattern: str = "yyyy-MM-dd") -> Step:
    """Tokens that are dates of that pattern."""
    return lambda ts: F.filter(ts, lambda t: F.try_to_timestamp(t, F.lit(pattern)).isNotNull())


def hyphenated_words(ts: Column) -> Column:
    """Words that a hyphen at a line's end had parted are whole again."""
    return F.split(F.regexp_replace(F.array_join(ts, "\u0001"), "-\u0001", ""), "\u0001")


def stemmer_override(table: dict[str, str]) -> Step:
    return each(lambda t: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), t), t))


def protected(words: list[str], inner: Step) -> Step:
    """``inner`` on all tokens but those of ``words``."""
    return an.conditional(lambda t: ~t.isin(list(words)), inner)


def word_delimiter(ts: Column) -> Column:
    """Parts at changes of case, between letters and digits, and at other signs."""
    return F.flatten(F.transform(ts, lambda t: F.regexp_extract_all(t, F.lit(r"\p{Lu}?\p{Ll}+|\p{Lu}+(?!\p{Ll})|\p{N}+|\p{L}+"), F.lit(0))))


def pattern_capture(pattern: str, original: bool = True) -> Step:
    return lambda ts: F.flatten(F.transform(ts, lambda t: F.array_distinct(F.concat(F.array(t), F.regexp_extract_all(t, F.lit(pattern), F.lit(1))) if original else F.regexp_extract_all(t, F.lit(pattern), F.lit(1)))))


def cjk_bigrams(ts: Column) -> Column:
    """Neighbouring pairs of the characters of Chinese, Japanese and Korean runs."""
    cjk = r"^[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]{2,}$"
    return F.flatten(F.transform(ts, lambda t: F.when(t.rlike(cjk), F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - 1, F.lit(1))), lambda i: F.substring(t, i, F.lit(2)))).otherwise(F.array(t))))


def common_grams(words: list[str], separator: str = "_") -> Step:
    """Each token, and after it the pair with the next where one of the two is common."""
    listed = list(words)

    def step(ts: Column) -> Column:
        def at(i: Column) -> Column:
            a, b = F.element_at(ts, i), F.try_element_at(ts, i + 1)
            pair = F.when(b.isNotNull() & (a.isin(listed) | b.isin(listed)), F.array(a, F.concat_ws(separator, a, b)))
            return F.coalesce(pair, F.array(a))

        return F.when(F.size(ts) > 0, F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(F.size(ts), F.lit(1))), at))).otherwise(ts)

    return step


def compound(words: list[str], low: int = 2) -> Step:
    """Each token, and after it the words of a dictionary that it holds."""
    listed = [w for w in words if len(w) >= low]
    return lambda ts: F.flatten(F.transform(ts, lambda t: F.array_distinct(F.concat(F.array(t), F.filter(F.array(*map(F.lit, listed)), lambda w: F.contains(t, w))))))


def min_hash(hashes: int = 16) -> Step:
    """The least hash of all tokens for each of several seeds, in hexadecimal."""
    return lambda ts: F.array(*[F.lpad(F.lower(F.hex(F.array_min(F.transform(ts, lambda t: F.xxhash64(t, F.lit(k)))))), 16, "0") for k in range(hashes)])


# stemming

_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
_M0, _M1 = f"^(?:{_C})?{_V}{_C}", f"^(?:{_C})?{_V}{_C}{_V}{_C}"
_ONE = f"^(?:{_C})?{_V}{_C}(?:{_V})?$"
_VOWEL, _SHORT = f"^(?:{_C})?[aeiouy]", f"^{_C}[aeiouy][^aeiouwxy]$"
_STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log"}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize".split()


def _cut(t: Column, suffix: str) -> Column:
    return F.substring(t, F.lit(1), F.length(t) - len(suffix))


def _longest(t: Column, table: dict[str, str], measure: str) -> Column:
    out = F.when(F.lit(False), t)
    for s in sorted(table, key=len, reverse=True):
        stem = _cut(t, s)
        out = out.when(F.endswith(t, F.lit(s)), F.when(stem.rlike(measure), F.concat(stem, F.lit(table[s]))).otherwise(t))
    return out.otherwise(t)


def porter(tokens: Column) -> Column:
    """The published Porter algorithm, step by step, each step one projection of the array."""

    def a(t: Column) -> Column:
        return F.when(F.length(t) < 3, t).when(t.rlike("(ss|i)es$"), _cut(t, "es")).when(t.rlike("[^s]s$"), _cut(t, "s")).otherwise(t)

    def b(t: Column) -> Column:
        def mend(s: Column) -> Column:
            return F.when(s.rlike("(at|bl|iz)$"), F.concat(s, F.lit("e"))).when(s.rlike(r"([^aeiouylsz])\1$"), _cut(s, "x")).when(s.rlike(_SHORT), F.concat(s, F.lit("e"))).otherwise(s)

        eed = F.when(_cut(t, "eed").rlike(_M0), _cut(t, "d")).otherwise(t)
        ed, ing = _cut(t, "ed"), _cut(t, "ing")
        return F.when(F.length(t) < 3, t).when(F.endswith(t, F.lit("eed")), eed).when(F.endswith(t, F.lit("ed")) & ed.rlike(_VOWEL), mend(ed)).when(F.endswith(t, F.lit("ing")) & ing.rlike(_VOWEL), mend(ing)).otherwise(t)

    def c(t: Column) -> Column:
        return F.when((F.length(t) > 2) & F.endswith(t, F.lit("y")) & _cut(t, "y").rlike(_VOWEL), F.concat(_cut(t, "y"), F.lit("i"))).otherwise(t)

    def four(t: Column) -> Column:
        out = F.when(F.lit(False), t)
        for s in sorted([*_STEP4, "ion"], key=len, reverse=True):
            stem = _cut(t, s)
            ok = stem.rlike(_M1) & stem.rlike("[st]$") if s == "ion" else stem.rlike(_M1)
            out = out.when(F.endswith(t, F.lit(s)), F.when(ok, stem).otherwise(t))
        return out.otherwise(t)

    def five(t: Column) -> Column:
        e = _cut(t, "e")
        return F.when(F.endswith(t, F.lit("e")) & (e.rlike(_M1) | e.rlike(_ONE) & ~e.rlike(_SHORT)), e).otherwise(t)

    def ll(t: Column) -> Column:
        return F.when(F.endswith(t, F.lit("ll")) & t.rlike(_M1), _cut(t, "l")).otherwise(t)

    for step in (a, b, c, lambda t: _longest(t, _STEP2, _M0), lambda t: _longest(t, _STEP3, _M0), four, five, ll):
        tokens = F.transform(tokens, step)
    return tokens


SUFFIXES = {
    "ar": "ات ان ون ين ية ه", "bg": "ите ата ият ът та ове и а", "bn": "গুলি দের রা", "br": "mente ções ção ando endo es os as s", "ca": "ament cions ció ant ent es s", "cz": "ami ové ých ého ách em y a e", "da": "erne erede ende erne en er et e", "nl": "heden ingen eren en e s",
    "et": "dele dega des st le ga d", "fi": "ssa ssä sta stä lla llä lle lta ltä n t", "fr": "issements issement ements ement euses euse eux ations ation ités ité ives ive aux es e s", "gl": "mente cións ción es os as s", "de": "ungen heiten keiten ung heit keit ern em en er es e s", "el": "ματα ους ων ες ος ας α η",
    "hi": "ियों ियां ाओं ाएं ों ें ी ा", "hu": "okat eket ban ben nak nek val vel ok ek ak t", "id": "kannya kan nya lah an i", "ga": "eanna anna acha aí í", "it": "azioni azione mente ità oso osa ivo iva i e a o", "lv": "iem ajiem ām ai as is us s", "lt": "iams omis ams as is us os", "no": "hetene heten ende ene en er et e",
    "fa": "هایی های ها ان", "pt": "amente mente ções ção idade ando endo es os as s", "ro": "urilor ului ilor elor ul ii le", "ru": "иями ями ами ого его ому ему ыми ими ов ев ей ам ям ах ях ый ий ой ая яя ое ее ые ие а я о е ы и у ю ь", "ckb": "ەکان ەکە ان", "es": "amente mente aciones ación idades idad ando iendo es os as a o e s",
    "sv": "heterna heten arna erna orna ande ade ar er or en et a e", "tr": "larından lerinden ların lerin lar ler dan den da de", "hy": "ների ներ ում ով ը", "eu": "etan aren ak an a", "th": "", "cjk": "",
}
STOP = {"fr": "le la les un une des du de et en à au aux que qui dans pour sur par pas ne est ce se", "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an", "es": "el la los las un una de del y en que a por con para se es no al lo su como", "it": "il lo la i gli le un una di e in che a per con non è del", "pt": "o a os as um uma de do da e em que para com não é", "nl": "de het een en van in is dat op te met voor niet", "sv": "och i att en det som på är av för med", "da": "og i at en det som på er af for med", "no": "og i å en det som på er av for med", "ru": "и в не на я что с он как это по но"}


def light_stem(language: str) -> Step:
    """The longest of the language's suffixes is cut where three letters stay."""
    listed = SUFFIXES[language].split()
    if not listed:
        return lambda ts: ts
    pattern = "^(.{3,}?)(?:" + "|".join(sorted(listed, key=len, reverse=True)) + ")$"
    return each(lambda t: F.regexp_replace(t, pattern, "$1"))


def language(code: str) -> Analyzer:
    """Standard tokens in lower case, less the stop words, lightly stemmed; English by Porter."""
    if code == "en":
        return Analyzer((), an.standard_tokens, (english_possessive, an.lowercase, an.stop(), porter))
    if code not in SUFFIXES:
        raise ValueError(f"no analyzer for {code}")
    first = {"fr": (elision(),), "ca": (elision(("d", "l", "m", "n", "s", "t")),), "it": (elision(("c", "l", "all", "dall", "dell", "nell", "sull", "un", "d")),), "ga": (irish_lowercase,)}.get(code, ())
    lower = {"tr": turkish_lowercase, "el": greek_lowercase}.get(code, an.lowercase)
    more = {"cjk": (cjk_width, cjk_bigrams), "ar": (decimal_digit, arabic_normalization), "fa": (decimal_digit, arabic_normalization, persian_normalization), "ckb": (sorani_normalization, decimal_digit), "hi": (decimal_digit, hindi_normalization), "bn": (decimal_digit, bengali_normalization), "de": (german_normalization,), "th": (decimal_digit,)}.get(code, ())
    tokenizer = an._found(r"[\p{L}\p{N}]+(?:['’][\p{L}\p{N}]+)*") if first else an.standard_tokens
    return Analyzer((), tokenizer, (*first, lower, an.stop(STOP.get(code, "").split()), *more, light_stem(code)))


NAMED = {
    **{f"{c}.{n}": c for c, n in (x.split(".") for x in "ar.Arabic hy.Armenian eu.Basque bn.Bengali bg.Bulgarian ca.Catalan cjk.CJK da.Danish nl.Dutch en.English et.Estonian fi.Finnish fr.French gl.Galician de.German el.Greek hi.Hindi hu.Hungarian id.Indonesian ga.Irish it.Italian lv.Latvian lt.Lithuanian no.Norwegian fa.Persian pt.Portuguese ro.Romanian ru.Russian ckb.Sorani es.Spanish sv.Swedish th.Thai tr.Turkish".split())},
    "br.Brazilian": "br",
    "cz.Czech": "cz",
}


def named(name: str) -> Analyzer:
    """An analyzer by its documented name, such as ``fr.French``, ``core.Stop`` or ``standard``."""
    plain = {
        "core.Stop": Analyzer((), an.letter_tokens, (an.lowercase, an.stop())),
        "standard.Classic": an.CLASSIC,
        "standard.UAX29URLEmail": Analyzer((), an.url_email_tokens, (an.lowercase, an.stop())),
        "core.UnicodeWhitespace": Analyzer((), an.pattern_tokens(r"[\s\p{Z}]+")),
        "core.Whitespace": an.WHITESPACE,
        "miscellaneous.LimitTokenCount": Analyzer((), an.standard_tokens, (an.lowercase, an.limit(10_000))),
    }
    if name in an.NAMED or name in plain:
        return an.NAMED.get(name) or plain[name]
    if name not in NAMED:
        raise ValueError(f"no analyzer is named {name}")
    return language(NAMED[name])
