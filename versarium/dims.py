"""Small constant dimensions: books, aliases, authors, hours, weekdays."""

from pyspark.sql import functions as F

from versarium.rx import quote

# ---- fixed values: scripture books (abbreviation, display name) -------------
OLD_TESTAMENT = [
    ("Gen", "Genesis"), ("Ex", "Exodus"), ("Lev", "Levitikus"), ("Num", "Numeri"),
    ("Dtn", "Deuteronomium"), ("Jos", "Josua"), ("Ri", "Richter"), ("Rut", "Rut"),
    ("1Sam", "1. Samuel"), ("2Sam", "2. Samuel"), ("1Kön", "1. Könige"), ("2Kön", "2. Könige"),
    ("1Chr", "1. Chronik"), ("2Chr", "2. Chronik"), ("Esra", "Esra"), ("Neh", "Nehemia"),
    ("Tob", "Tobit"), ("Jdt", "Judit"), ("Est", "Ester"), ("1Makk", "1. Makkabäer"),
    ("2Makk", "2. Makkabäer"), ("Ijob", "Ijob"), ("Ps", "Psalmen"), ("Spr", "Sprichwörter"),
    ("Koh", "Kohelet"), ("Hld", "Hoheslied"), ("Weish", "Weisheit"), ("Sir", "Jesus Sirach"),
    ("Jes", "Jesaja"), ("Jer", "Jeremia"), ("Klgl", "Klagelieder"), ("Bar", "Baruch"),
    ("Ez", "Ezechiel"), ("Dan", "Daniel"), ("Hos", "Hosea"), ("Joel", "Joel"), ("Am", "Amos"),
    ("Obd", "Obadja"), ("Jona", "Jona"), ("Mi", "Micha"), ("Nah", "Nahum"), ("Hab", "Habakuk"),
    ("Zef", "Zefanja"), ("Hag", "Haggai"), ("Sach", "Sacharja"), ("Mal", "Maleachi"),
]
NEW_TESTAMENT = [
    ("Mt", "Matthäus"), ("Mk", "Markus"), ("Lk", "Lukas"), ("Joh", "Johannes"),
    ("Apg", "Apostelgeschichte"), ("Röm", "Römer"), ("1Kor", "1. Korinther"),
    ("2Kor", "2. Korinther"), ("Gal", "Galater"), ("Eph", "Epheser"), ("Phil", "Philipper"),
    ("Kol", "Kolosser"), ("1Thess", "1. Thessalonicher"), ("2Thess", "2. Thessalonicher"),
    ("1Tim", "1. Timotheus"), ("2Tim", "2. Timotheus"), ("Tit", "Titus"), ("Phlm", "Philemon"),
    ("Hebr", "Hebräer"), ("Jak", "Jakobus"), ("1Petr", "1. Petrus"), ("2Petr", "2. Petrus"),
    ("1Joh", "1. Johannes"), ("2Joh", "2. Johannes"), ("3Joh", "3. Johannes"),
    ("Jud", "Judas"), ("Offb", "Offenbarung"),
]
# Old-translation table names that do not follow the rules in allioli_name().
ALLIOLI_SPECIAL = {
    "Genesis": "Genesis", "Exodus": "Exodus", "Levitikus": "Levitikus", "Numeri": "Numeri",
    "Deuteronomium": "Deuteronomium", "Richter": "Das Buch der Richter",
    "1. Könige": "Das 1. Buch der Koenige", "2. Könige": "Das 2. Buch der Koenige",
    "1. Chronik": "Das 1. Buch der Chronik", "2. Chronik": "Das 2. Buch der Chronik",
    "Esra": "Das Buch der Esra", "Nehemia": "Das Buch Nehemias",
    "1. Makkabäer": "Das 1. Buch der Makkabäer", "2. Makkabäer": "Das 2. Buch der  Makkabäer",
    "Psalmen": "Die Psalmen", "Sprichwörter": "Das Buch der Sprichwörter",
    "Hoheslied": "Das Hohelied", "Weisheit": "Das Buch der Weisheit",
    "Klagelieder": "Die Klagelieder des Jeremia", "Zefanja": "Das Buch Zefania",
    "Apostelgeschichte": "Apostelgeschichte", "Hebräer": "Hebräerbrief",
    "Offenbarung": "Offenbarung des Johannes",
}
TRANSLATIONS = ("allioli", "schoeningh", "einheit")
# Alternative book names used by searches beside the display names.
SEARCH_NAMES = [
    ("gen", "Genesis"), ("ex", "Exodus"), ("lev", "Levitikus"), ("num", "Numeri"),
    ("dtn", "Deuteronomium"), ("jos", "Josua"), ("ri", "Richter"), ("rut", "Ruth"),
    ("1sam", "1. Samuel"), ("2sam", "2. Samuel"), ("1kön", "1. Könige"), ("2kön", "2. Könige"),
    ("1chr", "1. Chronik"), ("2chr", "2. Chronik"), ("esr", "Esra"), ("neh", "Nehemia"),
    ("est", "Ester"), ("hiob", "Hiob"), ("ps", "Psalmen"), ("spr", "Sprichwörter"),
    ("pred", "Prediger"), ("hohel", "Hoheslied"), ("jes", "Jesaja"), ("jer", "Jeremia"),
    ("klgl", "Klagelieder"), ("ez", "Ezechiel"), ("dan", "Daniel"), ("hos", "Hosea"),
    ("joel", "Joel"), ("amos", "Amos"), ("obd", "Obadja"), ("jona", "Jona"), ("mi", "Micha"),
    ("nah", "Nahum"), ("hab", "Habakuk"), ("zef", "Zefanja"), ("hag", "Haggai"),
    ("sach", "Sacharja"), ("mal", "Maleachi"),
] + [(a.lower(), d) for a, d in NEW_TESTAMENT]

# ---- fixed values: author stems, first hit in this order wins ----------------
AUTHOR_STEMS = [
    ("athan", "Athanasius von Alexandria"), ("august", "Augustinus von Hippo"),
    ("ambros", "Ambrosius von Mailand"), ("hieron", "Hieronymus"),
    ("chrysost", "Johannes Chrysostomus"), ("basil", "Basilius von Cäsarea"),
    ("gregor", "Gregor von Nazianz"), ("orig", "Origenes"), ("tertull", "Tertullian"),
    ("cyprian", "Cyprian von Karthago"), ("ignat", "Ignatius von Antiochien"),
    ("justin", "Justin der Märtyrer"), ("iren", "Irenäus von Lyon"), ("clem", "Clemens von Rom"),
    ("hipp", "Hippolyt von Rom"), ("lact", "Lactantius"), ("euseb", "Eusebius von Caesarea"),
    ("cassian", "Johannes Cassianus"), ("leo", "Leo der Große"), ("isidor", "Isidor von Sevilla"),
    ("beda", "Beda Venerabilis"), ("damasc", "Johannes von Damaskus"),
    ("epiphan", "Epiphanius von Salamis"), ("didy", "Didymus der Blinde"),
    ("nyssenus", "Gregor von Nyssa"), ("nazian", "Gregor von Nazianz"),
    ("theod", "Theodoret von Cyrus"), ("cyrill", "Cyrill von Alexandria"),
    ("cyrill_jer", "Cyrill von Jerusalem"), ("maxim", "Maximus Confessor"),
    ("evagr", "Evagrius Ponticus"), ("palladius", "Palladius"), ("sozom", "Sozomenus"),
    ("socrat", "Sokrates Scholasticus"), ("theoph", "Theophilus von Alexandria"),
    ("ephraem", "Ephraem der Syrer"), ("rufin", "Rufinus von Aquileia"),
    ("sulp", "Sulpicius Severus"), ("prosper", "Prosper von Aquitanien"),
    ("paulin", "Paulinus von Nola"), ("cassiodor", "Cassiodorus"), ("boeth", "Boethius"),
    ("victor", "Victorinus"), ("optat", "Optatus von Mileve"), ("pelag", "Pelagius"),
    ("priscill", "Priscillian"), ("faustus", "Faustus von Riez"),
    ("vincent", "Vincentius von Lérins"), ("hilarius", "Hilarius von Poitiers"),
    ("martin", "Martin von Tours"), ("gennad", "Gennadius"), ("anast", "Anastasius Sinaita"),
    ("damas", "Papst Damasus"), ("symm", "Symmachus"), ("prudent", "Prudentius"),
    ("caesar", "Caesarius von Arles"), ("fulgent", "Fulgentius von Ruspe"),
]
# Corrected names for file stems.
NAME_CORRECTIONS = {
    "Athanasius von Alexandria": "Athanasius von Alexandria",
    "Basil of Caesarea": "Basilius von Cäsarea", "Clemens I": "Clemens von Rom",
    "Cyprian von Karthago": "Cyprian von Karthago", "augustinus-alexandria": "Augustinus von Hippo",
    "Cyril of Alexandria": "Cyrill von Alexandria", "ephraem-der-syrer": "Ephraem der Syrer",
    "Eusebius von Caesarea": "Eusebius von Caesarea",
    "Fulgentius von Ruspe Jh": "Fulgentius von Ruspe",
    "Hilarius von Poitiers": "Hilarius von Poitiers", "Martin von Tours": "Martin von Tours",
    "hiernoymus": "Hieronymus", "hippolyt": "Hippolyt von Rom",
    "ignatius von antiochien": "Ignatius von Antiochien",
    "johannes chysostomus": "Johannes Chrysostomus", "justin": "Justin der Märtyrer",
    "maximus": "Maximus Confessor", "origenes": "Origenes",
    "heilige-palladius-van-helenopolis": "Palladius von Helenopolis",
    "paulinus von nola": "Paulinus von Nola", "rufinus": "Rufinus von Aquileia",
    "tertullian": "Tertullian", "Theodoret von Kyrrhos": "Theodoret von Cyrus",
}
NAME_DESCRIPTIONS = {
    "Athanasius von Alexandria": "Verteidiger der Orthodoxie",
    "Basilius von Cäsarea": "Großer Kappadozier", "Clemens von Rom": "Früher Bischof von Rom",
    "Cyprian von Karthago": "Märtyrer und Kirchenvater",
    "Augustinus von Hippo": "Kirchenvater und Theologe",
    "Cyrill von Alexandria": "Theologe und Kirchenlehrer",
    "Ephraem der Syrer": "Syrischer Kirchenvater", "Eusebius von Caesarea": "Kirchenhistoriker",
    "Fulgentius von Ruspe": "Nordafrikanischer Theologe",
    "Hilarius von Poitiers": "Athanasius des Westens", "Martin von Tours": "Heiliger und Bischof",
    "Hieronymus": "Bibelübersetzer", "Hippolyt von Rom": "Früher Kirchenvater",
    "Ignatius von Antiochien": "Apostolischer Vater", "Johannes Chrysostomus": "Goldmund-Prediger",
    "Justin der Märtyrer": "Frühchristlicher Apologet", "Gregor von Nazianz": "Der Theologe",
    "Gregor von Nyssa": "Mystischer Theologe", "Irenäus von Lyon": "Kämpfer gegen Häresien",
    "Johannes von Damaskus": "Letzter Kirchenvater", "Leo der Große": "Großer Papst",
    "Maximus Confessor": "Byzantinischer Theologe", "Origenes": "Alexandrinischer Gelehrter",
    "Palladius": "Mönchshistoriker", "Paulinus von Nola": "Dichter und Bischof",
    "Pelagius": "Umstrittener Theologe", "Rufinus von Aquileia": "Übersetzer und Historiker",
    "Tertullian": "Lateinischer Kirchenvater", "Theodoret von Cyrus": "Exeget und Historiker",
}
DEFAULT_DESCRIPTION = "Kirchenvater"

# ---- fixed values: canonical hours -------------------------------------------
# Order of detection; the display order is HOUR_ORDER.
HOUR_KEYWORDS = [
    ("Lauds", ["morning prayer"]),
    ("Vespers", ["evening prayer", "evening prayer i", "evening prayer ii"]),
    ("Compline", ["night prayer", "night prayer i", "night prayer ii"]),
    ("OfficeOfReadings", ["office of readings"]), ("Terce", ["midmorning prayer"]),
    ("Sext", ["midday prayer"]), ("None", ["midafternoon prayer"]), ("Invitatory", ["invitatory"]),
]
HOUR_ORDER = ["Invitatory", "OfficeOfReadings", "Lauds", "Terce", "Sext", "None", "Vespers",
              "Compline"]
HOUR_LABELS = {
    "de": ["Invitatorium", "Lesehore", "Laudes", "Terz", "Sext", "Non", "Vesper", "Komplet"],
    "la": ["Invitatorium", "Officium lectionis", "Laudes", "Tertia", "Sexta", "Nona", "Vesperae",
           "Completorium"],
}
OFFICE_HOURS = [
    ("matins", "Matutinum", "Vigil (Matins)"), ("lauds", "Laudes", "Lauds"),
    ("prime", "Prima", "Prime"), ("terce", "Tertia", "Terce"), ("sext", "Sexta", "Sext"),
    ("none", "Nona", "None"), ("vespers", "Vesperae", "Vespers"),
    ("compline", "Completorium", "Compline"),
]
NEEDED_HOURS = ["Lauds", "Vespers", "OfficeOfReadings"]

# ---- fixed values: German calendar words --------------------------------------
WEEKDAYS = ["Sonntag", "Montag", "Dienstag", "Mittwoch", "Donnerstag", "Freitag", "Samstag"]
WEEKDAY_CATEGORY = ["Glorreicher Rosenkranz", "Freudenreicher Rosenkranz",
                    "Schmerzhafter Rosenkranz", "Glorreicher Rosenkranz",
                    "Lichtreicher Rosenkranz", "Schmerzhafter Rosenkranz",
                    "Freudenreicher Rosenkranz"]
MONTHS = ["Januar", "Februar", "März", "April", "Mai", "Juni", "Juli", "August", "September",
          "Oktober", "November", "Dezember"]

UMLAUTS = [("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("Ä", "Ae"), ("Ö", "Oe"), ("Ü", "Ue"),
           ("ß", "ss")]


def plain(text):
    for umlaut, base in UMLAUTS:
        text = text.replace(umlaut, base)
    return text


def allioli_name(display, new_testament):
    """Table name of a book in the old translation."""
    if display in ALLIOLI_SPECIAL:
        return ALLIOLI_SPECIAL[display]
    if new_testament:
        evangelist = display in ("Matthäus", "Markus", "Lukas", "Johannes")
        return plain(display) + ("evangelium" if evangelist else "brief")
    if display[:1].isdigit():
        return f"Das {display[:2]} Buch {display[3:]}"
    return f"Das Buch {display}"


def books():
    """(ix, abbr, display, nt, {translation: table name}) for all 73 books."""
    rows = []
    for ix, (abbr, display) in enumerate(OLD_TESTAMENT + NEW_TESTAMENT):
        nt = ix >= len(OLD_TESTAMENT)
        dotted = abbr[0] + "." + abbr[1:] if abbr[0].isdigit() else abbr
        rows.append((ix, abbr, display, nt, {
            "allioli": allioli_name(display, nt), "schoeningh": abbr, "einheit": dotted}))
    return rows


def book_aliases():
    """Reference tokens -> display name: abbreviations and full names, plain,
    spaced, dotted and umlaut-folded, in one collision-checked map (REF6)."""
    out = {}
    for _, abbr, display, _, _ in books():
        forms = {abbr, display}
        for name in (abbr, display.replace(". ", "")):
            if name[0].isdigit():
                forms |= {name, f"{name[0]} {name[1:]}", f"{name[0]}. {name[1:]}",
                          f"{name[0]}.{name[1:]}"}
        for form in forms | {plain(f) for f in forms}:
            if out.setdefault(form, display) != display:
                raise ValueError(f"alias {form} names two books")
    return out


def constant(spark, rows, schema):
    """A literal table. Always a constant of this module, so its size is fixed
    and known to the optimizer."""
    names = [part.split()[0] for part in schema.split(",")]
    typed = [f"CAST({name} AS {part.split()[1]}) AS {name}" for name, part in zip(names, schema.split(","))]
    return spark.sql(f"SELECT {', '.join(typed)} FROM {sql_values(rows, 'c', names)}")


def books_df(spark):
    return constant(spark, [(b[0], b[1], b[2], b[3]) for b in books()],
                    "book_ix int, abbr string, display string, nt boolean")


def book_names_df(spark):
    rows = [(b[2], t, b[4][t], b[3]) for b in books() for t in TRANSLATIONS]
    return constant(spark, rows, "display string, translation string, db_name string, nt boolean")


def literal_map(pairs):
    """A map column of constants for lookups without a join."""
    flat = []
    for key, value in pairs:
        flat += [F.lit(key), F.lit(value)]
    return F.create_map(*flat)


def sql_values(rows, name, columns):
    """The same constant table for the SQL side."""
    def lit(v):
        if isinstance(v, bool):
            return "true" if v else "false"
        return str(v) if isinstance(v, int) else quote(v)
    body = ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)
    return f"(VALUES {body}) AS {name}({', '.join(columns)})"
