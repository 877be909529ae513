import pytest

from lodestone.functions import analysis as an
from lodestone.functions import token_filters as tf
from lodestone.functions.analysis import Analyzer

WORDS = "caresses ponies ties caress cats feed agreed plastered bled motoring sing conflated troubled sized hopping tanned falling hissing fizzed failing filing happy sky relational conditional rational valenci digitizer operator feudalism decisiveness hopefulness formaliti sensitiviti triplicate formative electriciti electrical hopeful goodness revival allowance inference airliner adjustable defensible irritant replacement adjustment dependent adoption communism activate effective bowdlerize probate rate cease controll roll"
STEMS = "caress poni ti caress cat feed agre plaster bled motor sing conflat troubl size hop tan fall hiss fizz fail file happi sky relat condit ration valenc digit oper feudal decis hope formal sensit triplic form electr electr hope good reviv allow infer airlin adjust defens irrit replac adjust depend adopt commun activ effect bowdler probat rate ceas control roll"


def run(text, *filters, tokenizer=an.whitespace_tokens):
    return Analyzer((), tokenizer, filters).terms(text)


def test_porter_gives_the_published_examples(spark):
    got = run(WORDS, tf.porter)
    assert {w: s for w, s, g in zip(WORDS.split(), STEMS.split(), got) if s != g} == {}


@pytest.mark.parametrize(
    ("text", "f", "want"),
    [
        ("Anna's dog’s", tf.english_possessive, ["Anna", "dog"]),
        ("Istanbul'da", tf.apostrophe, ["Istanbul"]),
        ("l'homme qu'il", tf.elision(), ["homme", "il"]),
        ("U.S.A. cat's", tf.classic_filter, ["USA", "cat"]),
        ("١٢ ９", tf.decimal_digit, ["12", "9"]),
        ("ＡＢ", tf.cjk_width, ["AB"]),
        ("blåbärsö", tf.scandinavian_folding, ["blabarso"]),
        ("straße über neue", tf.german_normalization, ["strasse", "uber", "neue"]),
        ("ISTANBUL", tf.turkish_lowercase, ["ıstanbul"]),
        ("ΟΔΟΣ", tf.greek_lowercase, ["οδοσ"]),
        ("nAthair", tf.irish_lowercase, ["n-athair"]),
        ("a b", tf.keyword_repeat, ["a", "a", "b", "b"]),
        ("a b", tf.concatenate("+"), ["a+b"]),
        ("2024-01-02 x", tf.date_recognizer(), ["2024-01-02"]),
        ("eco- nomy is", tf.hyphenated_words, ["economy", "is"]),
        ("mice x", tf.stemmer_override({"mice": "mouse"}), ["mouse", "x"]),
        ("A B", tf.protected(["A"], an.lowercase), ["A", "b"]),
        ("PowerShot500 wi-fi", tf.word_delimiter, ["Power", "Shot", "500", "wi", "fi"]),
        ("a1b2", tf.pattern_capture("([a-z])"), ["a1b2", "a", "b"]),
        ("漢字仮 ab", tf.cjk_bigrams, ["漢字", "字仮", "ab"]),
        ("the quick fox", tf.common_grams(["the"]), ["the", "the_quick", "quick", "fox"]),
        ("", tf.common_grams(["the"]), []),
        ("donaudampf x", tf.compound(["donau", "dampf"]), ["donaudampf", "donau", "dampf", "x"]),
    ],
)
def test_filters(spark, text, f, want):
    assert run(text, f) == want


def test_min_hash_ignores_order(spark):
    a, b = run("x y z", tf.min_hash(4)), run("z x y", tf.min_hash(4))
    assert a == b and len(a) == 4 and a != run("x y w", tf.min_hash(4))


def test_named_analyzers(spark):
    assert tf.named("en.English").terms("The horses' running") == ["hors", "run"]
    assert tf.named("fr.French").terms("L'amélioration des maisons") == ["amélior", "maison"]
    assert tf.named("cjk.CJK").terms("漢字仮") == ["漢字", "字仮"]
    assert tf.named("core.Stop").terms("The x2 y") == ["x", "y"]
    for name in tf.NAMED:
        assert tf.named(name).terms("word") != []
    with pytest.raises(ValueError):
        tf.named("xx.None")
