"""One spelling per pattern, valid in Java and in RE2, with Unicode classes.

Patterns are written with the Unicode meaning of ``\\s \\S \\d \\w`` and are
expanded to explicit classes, because the bare escapes are ASCII-only in Java
and in RE2 and differ on vertical tab and no-break space. ``\\A`` and ``\\z``
are used for text ends; ``^`` and ``$`` only with the ``m`` flag.
"""

import re
import unicodedata

from pyspark.sql import functions as F

_SPACE = r"\s\p{Z}\x0B\x1C-\x1F\x{85}"
_CLASSES = {"s": _SPACE, "d": r"\p{Nd}", "w": r"\p{L}\p{N}_"}


def _listed(low, more):
    """A class for Java: its Latin-1 characters one by one, which Java looks up in a bitmap, and the rest
    behind a range, so that a character of Latin-1 is not asked for its category."""
    return "".join(rf"\x{{{code:X}}}" for code in low) + f"[{more}]"


_LETTERS = [code for code in range(256) if chr(code) == "_" or unicodedata.category(chr(code))[0] in "LN"]
# The same classes as _CLASSES, spelled for Java.
_JAVA_CLASSES = {
    "s": _listed([*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0],
                 r"\x{1680}-\x{3000}&&[\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"),
    "d": _listed(range(0x30, 0x3A), r"\x{660}-\x{10FFFF}&&\p{Nd}"),
    "w": _listed(_LETTERS, r"\x{100}-\x{10FFFF}&&[\p{L}\p{N}]"),
}
# A pattern that begins with a letter which folds to nothing but its other case (not i, k, s).
_SIMPLE_START = re.compile(r"[A-HJLM-RT-Za-hjlm-rt-z](?![*+?{])")
# Word boundaries by look-around in Java; RE2 has only the ASCII \b.
BOW, EOW = "\ue000", "\ue001"


def expand(pattern, classes=_CLASSES):
    out, in_class, i = [], False, 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            nxt = pattern[i + 1]
            if nxt in classes:
                out.append(classes[nxt] if in_class else f"[{classes[nxt]}]")
            elif nxt.lower() in classes and nxt.isupper():
                if in_class:
                    raise ValueError(f"negated class inside brackets: {pattern}")
                out.append(f"[^{classes[nxt.lower()]}]")
            else:
                out.append(ch + nxt)
            i += 2
            continue
        if ch == "[" and not in_class:
            in_class = True
        elif ch == "]" and in_class:
            in_class = False
        out.append(ch)
        i += 1
    return "".join(out)


class Rx:
    """A pattern with flags (i, m, s) and a replacement written with $1.

    ``java`` is a cheaper spelling with the same result, for Java alone.
    """

    def __init__(self, pattern, to="", flags="", re2=None, re2_to=None, java=None):
        self.pattern, self.flags, self.to = pattern, flags, to
        java = expand(pattern if java is None else java, _JAVA_CLASSES)
        java = java.replace(BOW, r"(?<![\p{L}\p{N}_])").replace(EOW, r"(?![\p{L}\p{N}_])")
        if flags == "i" and _SIMPLE_START.match(java):
            # a first letter in two cases is looked up in a bitmap; folding is left to the places that have it
            self.java = f"(?d)[{java[0].upper()}{java[0].lower()}](?iu)" + java[1:]
        else:
            self.java = f"(?d{flags}{'u' if 'i' in flags else ''})" + java
        plain = expand(re2 if re2 is not None else pattern)
        self.re2 = (f"(?{flags})" if flags else "") + plain.replace(BOW, r"\b").replace(EOW, r"\b")
        target = re2_to if re2_to is not None else to
        self.re2_to = target.replace("$", "\\")

    def sub(self, col):
        return F.regexp_replace(col, self.java, self.to)

    def found(self, col):
        return F.rlike(col, F.lit(self.java))

    def group(self, col, idx=1):
        return F.regexp_extract(col, self.java, idx)

    def all(self, col, idx=0):
        return F.regexp_extract_all(col, F.lit(self.java), F.lit(idx))

    def sql_sub(self, expr):
        return f"regexp_replace({expr}, {quote(self.re2)}, {quote(self.re2_to)}, 'g')"

    def sql_found(self, expr):
        return f"regexp_matches({expr}, {quote(self.re2)})"

    def sql_group(self, expr, idx=1):
        return f"regexp_extract({expr}, {quote(self.re2)}, {idx})"

    def sql_all(self, expr, idx=0):
        return f"regexp_extract_all({expr}, {quote(self.re2)}, {idx})"


def quote(text):
    return "'" + text.replace("'", "''") + "'"


def chain(col, rules):
    for rule in rules:
        col = rule.sub(col)
    return col


def sql_chain(expr, rules):
    for rule in rules:
        expr = rule.sql_sub(expr)
    return expr


def any_of(patterns, flags="", group=True):
    """One alternation instead of N passes over the text."""
    return Rx("|".join(f"(?:{p})" if group else p for p in patterns), flags=flags)
