"""The cleaning, audit and classification patterns.

``\\s \\d \\w`` have their Unicode meaning here (see rx.py).
"""

from versarium.rx import BOW, EOW, Rx, any_of

# ---- text normalisation -------------------------------------------------------
TAGS = Rx(r"<[^>]+>")
BREAKS = Rx(r"<br\s*/?>", "\n")
# in Java, a run that is one blank stays as it is
SPACES = Rx(r"\s+", " ", java=r"(?: \s|[\s&&[^ ]])\s*+")
EDGE_SPACE = Rx(r"\A\s+|\s+\z")
UP_TO_SPACE = Rx(r"(?s)\A\s*(.*\S)", java=r"(?s)\A\s*+(.*\S)")
UP_TO_WORD = Rx(r"""(?s)\A.*[\w".!?„“]""")
FOOTNOTE_REFS = [Rx(r"\x{21A9}\x{FE0E}?"), Rx(r"\[\d+\]"), Rx(r"\(\d+\)")]
PAGE_NUMBERS = [Rx(r"S\.\s*\d+"), Rx(r"^\s*\d+\s*", flags="m"), Rx(r"\s+\d+\s*$", flags="m")]
TRIM_ARTIFACTS = [Rx(r",\s*de\s*\z"), Rx(r",\s*\d+\s*\z"), Rx(r"\s+\d+\s*\z"), Rx(r"\A\d+\s*,")]
NUMBERING = [Rx(r"\d+\.")]
# What a text must hold for the rules above and below to change it.
DIGIT = Rx(r"\d")
DIGIT_OR_SPACE, E_OR_SPACE, NO_START = Rx(r"[\d\s]"), Rx(r"[e\s]"), Rx(r"""[^\w"„“]""")
TWO_COMMAS, TWO_STOPS = Rx(r"[,;]\s*[,;]"), Rx(r"\.\s*\.")
WEB_ARTIFACTS = [Rx(r"https?://\S+"), Rx(r"www\.\S+"), Rx(r"[A-Z]{2,}\s*\d+")]


def _upto_word(label):
    # "label, then everything before the next word character"
    return Rx(label + r".*?(?=\w)", flags="i", re2=label + r"[^\w\n]*(\w)", re2_to="$1")


BIBLIO_REFS = [
    _upto_word("Titel Werk:"), _upto_word("Autor:"), _upto_word("Identifier:"),
    _upto_word("Tag:"), _upto_word("Time:"), Rx(r"CPG\s*\d+", flags="i"), _upto_word("BKV"),
    _upto_word("SWKV"), Rx(r"Übersetzung\s*\([^)]*\):", flags="i"),
    Rx(r"Kommentar\s*\([^)]*\):", flags="i"), Rx(r"lib\.\s*[IVX]+", flags="i"),
    Rx(r"Hist\.\s*\w+", flags="i"), Rx(r"E\.\s*[IVX]+", flags="i"), Rx(r"c\.\s*\d+", flags="i"),
    Rx(r"cap\.\s*\d+", flags="i"), Rx(r"§\s*\d+", flags="i"), Rx(r"Nr\.\s*\d+", flags="i"),
    Rx(r"n\.\s*\d+", flags="i"),
]
# What a text must hold, as one of these literals, for the rules above to change it (\u212a folds to k).
BIBLIO_NEEDS = [
    ("k:", "K:", "\u212a:"), ("r:", "R:"), ("r:", "R:"), ("g:", "G:"), ("e:", "E:"), ("cpg", "CPG", "Cpg", "cPg", "cpG", "CPg", "CpG", "cPG"),
    ("kv", "KV", "Kv", "kV"), ("kv", "KV", "Kv", "kV"), ("):",), ("):",), ("b.", "B."), ("t.", "T."), ("e.", "E."),
    ("c.", "C."), ("p.", "P."), ("§",), ("r.", "R."), ("n.", "N."),
]
PAGE_REFS = [
    Rx(BOW + r"S\.\s*\d+"), Rx(BOW + r"\d+\.\s*\d+" + EOW), Rx(BOW + r"[IVX]+,\s*c\.\s*\d+\.?"),
]
WORK_REFS = PAGE_REFS + [
    Rx(r"S\.\s*\d+"), Rx(BOW + r"lib\.\s*[IVX]+"), Rx(BOW + r"Hist\.\s*[A-Z][a-z]*\.?"),
    Rx(BOW + r"\d+\.\s*Februar\s*\([^)]*\)"),
]
NOT_ALLOWED = Rx(r"""[^\w\s.,;:!?()\[\]"'„“‚’–—-]""", " ")
TIDY = [
    Rx(r"\(\s*\)"), Rx(r"\[\s*\]"), Rx(r"\s*[,;]\s*[,;]+", ",", java=r"\s*+[,;]\s*+[,;]+"), Rx(r"\s*\.\s*\.+", ".", java=r"\s*+\.\s*+\.+"), SPACES,
    Rx(r"""\A[^\w"„“]+"""), Rx(r"""[^\w".!?„“]+\z"""),
]
NAME_TITLES = Rx(r"Priester|Diakon|Bischof")
PRIEST_OR_DEACON = Rx(r"Priester|Diakon")
AT_MOST_THREE_WORDS = Rx(r"\A\s*(?:\S+\s*){0,3}\z", java=r"\A\s*+(?:\S++\s*+){0,3}+\z")
TWO_NAMES_LINE = Rx(r"\A\s*[A-Z][a-z]+,?\s+[A-Z][a-z]+\.?\s*\z")
TWO_NAMES = Rx(r"\A[A-Z][a-z]+,?\s+[A-Z][a-z]+\.?\z")
MARKERS = [
    Rx(r"\s*\]//ESyn0812/<t>\s*\$ŽT://ESyn0812/Nr\. \d+\s*\$ŽG://ESyn0812/\s*"),
    Rx(r"\$ŽT://ESyn0812/Nr\. \d+"), Rx(r"\$ŽG://ESyn0812/"),
    Rx(r"//ESyn0812/.*?(?:,|\z)", re2=r"//ESyn0812/[^,\n]*,?"), Rx(r"\[\]"),
    Rx(r"\A[ ;,]+|[ ;,]+\z"),
]
VERSE_TIDY = [Rx(r"\s{2,}", " "), Rx(r"(?:\. )+", ". "), Rx(r"\A[\s,;]+|[\s,;]+\z"), Rx(r"[\[\]]")]
TITLE_CLEAN = [
    Rx(r"Übersetzung \([^)]+\):\s*"), Rx(r"Kommentar \([^)]+\):\s*"), Rx(r"\(BKV[^)]*\)"),
    Rx(r"\s*\([^)]*\)\s*\z"), SPACES,
]
TITLE_TRAILING_NUMBER = Rx(r"\s*\d+\s*\z")
NON_ID = Rx(r"[^a-zA-Z0-9]", "_")
NON_SLUG = [Rx(r"[^a-z0-9]+", "-"), Rx(r"\A-|-\z")]
UNSAFE_FILE = Rx(r'[<>:"/\\|?*]')
RTF_CODES = [Rx(r"\\[a-z]+\d*\s?"), Rx(r"[{}]"), SPACES]
SENTENCE_LINES = [Rx(r"\r\n", "\n"), Rx(r"\.\.\.", "…"), Rx(r"([.!?]+)\s+", "$1\n"),
                  Rx(r"\n{2,}", "\n")]
WORK_ID_CPG = Rx(r"cpg-[\d\w-]+")
LAST_PATH_PART = Rx(r"([^/]*)\z")
FILE_STEM = [
    Rx(r"\.[^/.]+\z"), Rx(r"\AIkone_"), Rx(r"\AHl\._"), Rx(r"\A\d+px-"), Rx(r"_", " "),
    Rx(r"-[0-9A-Za-z_]+-\d+\z"), Rx(r"\d+\z"),
]
# Word-level noise dropped before two words are compared.
WORD_FORM = [Rx(r"""[.,;:!?"'()\[\]{}«»„”]"""), Rx(r"\s+")]
DUP_NOISE = [Rx(r"[^\w\s]"), Rx(r"\d+"), SPACES]
DUP_NOISE_JAVA = [Rx(r"[^\w\s]|\d", java=r"[\d[^\w\s]]+"), SPACES]  # the same in two passes

# ---- whole-line removal ---------------------------------------------------------
METADATA_LINES = {
    "formatter": any_of([
        r"Titel Werk:", r"Autor:", r"Identifier:", r"Tag:", r"Time:", r"UNTITLED", r"\A\s*S\s*\z",
        r"\A\s*\d+\s*\z", r"lib\.\s*I", r"Hist\.", r"E\.\s*VIII",
    ], "i"),
    "archive": any_of([
        r"\A\s*Titel Werk:", r"\A\s*Autor:", r"\A\s*Identifier:", r"\A\s*Tag:", r"\A\s*Time:",
        r"\A\s*\d+\s*\z", r"\A\s*UNTITLED", r"\A\s*\[Seite \d+\]", r"\A\s*S\s*\z", r"BKV",
        r"Bibliothek", r"Download", r"Version",
    ], "i"),
    "download": any_of([
        r"\A\s*UNTITLED", r"\A\s*Titel Werk:", r"\A\s*Autor:", r"\A\s*Identifier:", r"\A\s*Tag:",
        r"\A\s*Time:", r"\A\s*Inhaltsverzeichnis", r"\A\s*Bibliographie",
        r"\A\s*Literaturverzeichnis", r"\A\s*Einleitung", r"\A\s*Vorwort", r"\A\s*Seite \d+",
        r"\A\s*\d+\s*\z", r"BKV", r"Bibliothek", r"Download", r"Version", r"\A\s*\[Seite \d+\]",
        r"\A\s*\|\s*\d+\s*\|", r"\A\s*Copyright", r"\A\s*©", r"\A\s*ISBN", r"\A\s*Verlag",
        r"\A\s*Impressum", r"\A\s*Anmerkungen", r"\A\s*Fußnoten", r"\A\s*Register", r"\A\s*Index",
        r"\A\s*Stichwortverzeichnis", r"\A\s*Printed in", r"\A\s*All rights reserved",
        r"\A\s*Kein Teil", r"\A\s*Übersetzung", r"\A\s*Übersetzer", r"\A\s*Hrsg\.",
        r"\A\s*Herausgeber", r"\A\s*Redaktion", r"\A\s*Lektorat", r"\A\s*Korrektur", r"\A\s*Satz",
        r"\A\s*Druck", r"\A\s*Bindung", r"\A\s*Gedruckt", r"\A\s*Erste Auflage",
        r"\A\s*\d+\. Auflage", r"\A\s*www\.", r"\A\s*https?://", r"\A\s*E-Mail", r"\A\s*email",
        r"\A\s*Tel\.", r"\A\s*Fax", r"\A\s*Telefon", r"\A\s*Telefax",
    ], "i"),
}
NAV_LINES = {
    "base": any_of([
        r"navigation", r"sprache", r"copyright", r"impressum", r"datenschutz", r"cookies",
        r"start.*werke.*suche", r"\Ade\s*en\s*fr\z", r"unifr\.ch",
    ], "i"),
    "strict": any_of([
        r"navigation", r"sprache", r"copyright", r"impressum", r"datenschutz", r"cookies",
        r"start.*werke.*suche", r"\Ade\s*en\s*fr\z", r"unifr\.ch", r"resultate filtern",
        r"schlagwörter", r"gregor emmenegger", r"theologische fakultät", r"patristik",
        r"bibliothek der kirchenväter", r"text anzeigen", r"editionen", r"übersetzungen",
        r"kommentare",
    ], "i"),
}
ALL_DIGITS = Rx(r"\A\d+\z")
CAPS_ONLY = Rx(r"\A[A-Z\s]+\z")

# ---- predicates ------------------------------------------------------------------
HAS_WORD = Rx(r"[\p{L}\p{Nl}\p{No}_]")
METADATA_START = any_of([
    r"\A(?:Titel|Autor|Identifier|Tag|Time|CPG|BKV|SWKV)", r"\AÜbersetzung\s*\(",
    r"\AKommentar\s*\(", r"\A\d+\s*\z", r"\AS\.\s*\d+", r"\Alib\.\s*[IVX]", r"\AHist\.\s*",
    r"\AE\.\s*[IVX]",
], "i")
# as one anchored pattern: the branches are tried at the start alone
METADATA_START.java = r"(?diu)\A(?:" + METADATA_START.java.removeprefix("(?diu)").replace(r"\A", "") + ")"
UNWANTED = any_of([
    r"start\s+werke\s+einführung", r"download\s+(?:docx|epub|pdf|rtf)", r"bibliographische\s+angabe",
    r"©\s*\d{4}", r"impressum", r"datenschutz", r"copyrights?\s+kontakt",
    r"sponsoren\s*/\s*mitarbeiter", r"theologische\s+fakultät", r"miséricorde.*fribourg",
    r"gregor\s+emmenegger", r"text\s+anzeigen", r"scans\s+dieser\s+version",
    r"übersetzungen\s+dieses\s+werks", r"kommentare\s+zu\s+diesem\s+werk",
    r"drucken\s+fehler\s+melden", r"notes\s+and\s+elucidations", r"inhaltsangabe",
    r"epistle\s+vergleichen", r"bei\s+sokrates.*h\.\s*e\.", r"bei\s+gelasius.*hist\.",
    r"in\s+cassiodor.*historia", r"bei\s+nicephorus.*h\.\s*e\.", r"ihm\s+folgte\s+athanasius",
    r"sehr\s+fehlerhaft.*bei", r"\d+\s+zu\s+nicäa.*concilium", r"nach\s+andern.*april",
])
UNWANTED_WORDS = [
    "imprimer", "rapporter", "fehler melden", "copyright", "navigation", "menu", "footer", "header",
    "login", "search", "drucken", "error", "print", "report error", "bibliothek der kirchenväter",
]
ERROR_PAGE = "The page you requested was not found."
SUSPICIOUS = [
    ("number_de_end", Rx(r"\d+,?\s*de\s*\z", flags="i")), ("number_end", Rx(r"\s+\d+\s*\z", flags="i")),
    ("bkv_end", Rx(r"BKV\s*\z", flags="i")), ("swkv_end", Rx(r"SWKV\s*\z", flags="i")),
    ("cpg_ref", Rx(r"CPG\s*\d+", flags="i")), ("page_ref", Rx(r"S\.\s*\d+", flags="i")),
    ("lib_ref", Rx(r"lib\.\s*[IVX]", flags="i")), ("only_number", Rx(r"\A\s*\d+\s*\z", flags="i")),
    ("title_label", Rx(r"Titel\s*Werk:", flags="i")), ("identifier", Rx(r"Identifier:", flags="i")),
]

# ---- classification ------------------------------------------------------------------
YEARS = Rx(r"(\d{1,4})[\s–-]+(\d{1,4})")
GERMAN_PAGE = ["übersetzung (deutsch)", "deutsch", "german translation", ".docx", ".epub", ".pdf",
               ".rtf"]
GERMAN_LINK = ["deutsch", "übersetzung", "german"]
LATIN_WORDS = ["Deus", "Dominus", "Gloria", "Alleluia", "Amen", "Patri"]
SECTION_ROLES = [
    ("intro", ["einleitung", "vorwort", "vorrede", "widmung", "prolog", "brief des herausgebers",
               "lebensbeschreibung", "biographie", "inhalt", "leben"]),
    ("appendix", ["anhang", "anhaenge", "nachtrag", "erganzung", "appendix"]),
    ("notes", ["anmerkung", "anmerkungen", "notiz", "notizen", "hinweis", "erklarung", "kommentar",
               "bemerkung"]),
]
INTRO_PREFIXES = ["einleitung", "vorwort", "vorrede", "widmung", "prolog", "brief des herausgebers"]
INTRO_WORDS = ["einleitung", "vorwort", "einführung", "vorbemerkung", "introduction", "preface"]
BOOK_HEADING = Rx(r"buch\s+[ivx]+|book\s+\d+|liber\s+[ivx]+", flags="i")
BOOK_NUMBER = Rx(r"[ivx]+|\d+", flags="i")
CHAPTER_HEADING = Rx(r"kapitel\s+\d+|chapter\s+\d+|kap\.\s+\d+", flags="i")
FIRST_NUMBER = Rx(r"\d+")
VERSE_START = Rx(r"\A(\d+)\.\s*(\d+)")
NUMBER_START = Rx(r"\A(\d+)\.")
SECTION_START = any_of([r"\AKapitel\s+\d+", r"\AKap\.\s+\d+", r"\A\d+\.\s+[A-Z]",
                        r"\A[A-Z][a-z]+\s+\d+", r"\ABrief\s+\d+", r"\ABuch\s+\d+"])
CHAPTER_HEADER = [Rx(r"Kapitel\s+(\d+)", flags="i"), Rx(r"Kap\.\s+(\d+)", flags="i"),
                  Rx(r"\A\s*(\d+)\.\s+", flags="i"), Rx(r"\A\s*(\d+)\s+", flags="i"),
                  Rx(r"Chapter\s+(\d+)", flags="i"), Rx(r"Book\s+(\d+)", flags="i")]
STRUCTURE = {
    "book": any_of([r"Buch\s+[IVX]+", r"Book\s+\d+", r"Liber\s+[IVX]+", r"Teil\s+[IVX]+",
                    r"Band\s+\d+"], "i"),
    "chapter": any_of([r"Kapitel\s+\d+", r"Chapter\s+\d+", r"Kap\.\s+\d+", r"Cap\.\s+\d+",
                       r"§\s*\d+", r"Abschnitt\s+\d+"], "i"),
    "verse": any_of([r"\d+\.\s*\d+", r"Vers\s+\d+", r"V\.\s*\d+", r"Nr\.\s*\d+", r"\[\d+\]"]),
    "footnote": any_of([r"<sup[^>]*>\d+</sup>", r"\(\d+\)", r"¹", r"²", r"³",
                        r"<a[^>]*class[^>]*footnote[^>]*>", r"<div[^>]*class[^>]*footnote[^>]*>"],
                       "i"),
    "intro": any_of([r"Einleitung", r"Vorwort", r"Einführung", r"Vorbemerkung", r"Introduction",
                     r"Preface", r"Prolegomena"], "i"),
}
PARAGRAPH_TAG = Rx(r"<p(?:\s[^>]*)?>", flags="i")

# ---- segmentation ----------------------------------------------------------------------
BLANK_LINES = Rx(r"\n\s*\n")
SENTENCE_END = Rx(r"[.!?]+")
SENTENCE_GAP = Rx(r"(?<=[.!?])\s+(?=[A-ZÄÖÜ])", re2=r"([.!?])\s+([A-ZÄÖÜ])")
CHAPTER_MARKERS = any_of([r"\n\s*Kapitel\s+\d+", r"\n\s*Kap\.\s+\d+", r"\n\s*\d+\.\s+[A-Z]",
                          r"\n\s*Brief\s+\d+", r"\n\s*Buch\s+\d+"])
LEADING_NUMBER = Rx(r"\A(\d+)\.?\s*(.*)\z")
NUMBERED_FRAGMENT = Rx(r"(\A|\s)(\d+\))", "\u0001$2")
QUOTES = Rx(r"„[^“]+“|«[^»]+»|»[^«]+«|“[^”]+”|‚[^’]+’|\"[^\"]+\"|'[^']+'")
FOOTNOTE_SLOT = Rx(r"\{FN([^}]+)\}")
TOKENS = Rx(r"\s+|[.,;:!?\"'()\[\]{}«»„”]|[^\s.,;:!?\"'()\[\]{}«»„”]+")
WORD_TOKEN = Rx(r"[^\s.,;:!?\"'()\[\]{}«»„”]+")
SEARCH_TOKEN = Rx(r"\w+")

# ---- office page -------------------------------------------------------------------------
PSALM_HEADER = Rx(r"<FONT[^>]*><I>Psalmus (\d+)</I></FONT>")
ANTIPHON = Rx(r"<I>Ant\.</I></FONT>\s*([^<]+)")
OFFICE_VERSE = Rx(r"(\d+):(\d+)\s*([^<\n]+)")
COLLECT = Rx(r"<FONT[^>]*><I>(Oratio|Prayer)</I></FONT>(?s:.)*?<br/>")
VERSICLE = Rx(r"℣\.\s*([^℟\n]+)\s*℟\.\s*([^℣\n]+)")
