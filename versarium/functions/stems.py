"""German word stems as column code: the published Snowball rules for German."""

from pyspark.sql import functions as F

from versarium.functions.text import let

# Fixed values of the rules.
VOWELS = "aeiouyäöü"
BEFORE_S = "bdfghklmnrt"
BEFORE_ST = "bdfghklmnt"

_V, _C = f"[{VOWELS}]", f"[^{VOWELS}]"
FIRST_REGION = f"^{_C}*{_V}+{_C}"
SECOND_REGION = f"^{_C}*{_V}+{_C}+{_V}+{_C}"


def _left(w, n):
    return F.substring(w, F.lit(1), F.length(w) - n)


def _ending(w, endings):
    """The longest of the endings that the word has, or ''."""
    return F.regexp_extract(w, f"({endings})$", 1)


def _region(w, pattern):
    found = F.length(F.regexp_extract(w, pattern, 0))
    return F.when(found > 0, found).otherwise(F.length(w))


def _cut(w, ending, region, when=True):
    """The word without the ending, where that begins in the region."""
    inside = (ending != "") & (F.length(w) - F.length(ending) >= region)
    return F.when(inside & when, _left(w, F.length(ending))).otherwise(w)


def _inflection(w, r1):
    def strip(e):
        bare = _cut(w, e, r1, (e != "s") | F.rlike(w, F.lit(f"[{BEFORE_S}]s$")))
        doubled = e.isin("e", "en", "es") & (bare != w) & F.endswith(bare, F.lit("niss"))
        return F.when(doubled, _left(bare, F.lit(1))).otherwise(bare)
    return let(_ending(w, "ern|em|er|en|es|e|s"), strip)


def _comparison(w, r1):
    return let(_ending(w, "est|en|er|st"), lambda e: _cut(w, e, r1, (e != "st") | F.rlike(w, F.lit(f".{{3}}[{BEFORE_ST}]st$"))))


def _derivation(w, r1, r2):
    def strip(e):
        free = ~e.isin("ig", "ik", "isch") | ~F.rlike(w, F.lit("e(ig|ik|isch)$"))
        def further(bare):
            ig = _cut(bare, _ending(bare, "ig"), r2, ~F.endswith(bare, F.lit("eig")))
            return (F.when(bare == w, w).when(e.isin("end", "ung"), ig)
                    .when(e.isin("lich", "heit"), _cut(bare, _ending(bare, "er|en"), r1))
                    .when(e == "keit", _cut(bare, _ending(bare, "lich|ig"), r2)).otherwise(bare))
        return let(_cut(w, e, r2, free), further)
    return let(_ending(w, "lich|heit|keit|isch|end|ung|ig|ik"), strip)


def german(c):
    """The stem of a lower-case word; null stays null, words of one or two letters stay as they are.

    `u`, then `y`, between vowels count as consonants. The three groups of endings go one after the
    other, each only from the regions behind the first and the second syllable. Umlauts lose their dots.
    """
    word = F.replace(c, F.lit("ß"), F.lit("ss"))
    for letter in "uy":
        word = F.regexp_replace(word, f"({_V}){letter}({_V})", f"$1{letter.upper()}$2")

    def strip(w):
        short = F.length(w) < 3
        regions = F.struct(F.when(short, F.length(w)).otherwise(F.greatest(_region(w, FIRST_REGION), F.lit(3))).alias("r1"),
                           F.when(short, F.length(w)).otherwise(_region(w, SECOND_REGION)).alias("r2"))
        return let(regions, lambda r: let(_inflection(w, r["r1"]), lambda a: let(
            _comparison(a, r["r1"]), lambda b: _derivation(b, r["r1"], r["r2"]))))
    return F.translate(let(word, strip), "UYäöü", "uyaou")
