"""Word lists and patterns of the normalisers. All are fixed values: results depend on each of them."""

#: Legal forms that are dropped from the end of a name, by country.
LEGAL_SUFFIXES = {
    "default": ("incorporated", "corporation", "company", "limited", "llc", "inc", "corp", "ltd", "co", "plc", "llp", "lp", "sa", "ag", "gmbh"),
    "us": ("incorporated", "corporation", "company", "limited", "llc", "inc", "corp", "ltd", "co"),
    "in": ("private limited", "pvt ltd", "private ltd", "limited", "llp", "ltd", "pvt", "inc"),
    "fr": ("sarl", "sasu", "sas", "sci", "sa", "fils", "groupe", "llc", "ltd", "inc", "corp", "co"),
}

COUNTRY_ALIASES = {
    "united states": "us", "usa": "us", "u s a": "us", "us": "us", "united states of america": "us",
    "india": "in", "in": "in", "france": "fr", "fr": "fr",
}

#: Street words to their short forms; forms with a full stop never survive folding.
STREET_TERMS = {
    "street": "st", "st": "st", "road": "rd", "rd": "rd", "avenue": "ave", "ave": "ave", "boulevard": "blvd", "blvd": "blvd",
    "drive": "dr", "dr": "dr", "lane": "ln", "ln": "ln", "roadway": "rd", "highway": "hwy", "hwy": "hwy", "parkway": "pkwy",
    "pkwy": "pkwy", "place": "pl", "pl": "pl", "square": "sq", "sq": "sq", "terrace": "ter", "ter": "ter", "rue": "rue",
    "r": "rue", "route": "rte", "rte": "rte", "chemin": "che", "ch": "che",
}

ALIAS_MARKER = r"\b(?:dba|d/b/a|doing\s+business\s+as|aka|a/k/a|trading\s+as|t/a)\b\s*[:\-]?\s*"
DOMAIN = r"(?<![\w@])(?:https?://)?(?:www\.)?([a-z0-9][a-z0-9.-]*\.[a-z]{2,})(?![\w.-])"
HOUSE_NUMBER = r"(?<!\w)(?:no\.?\s*)?(\d{1,7})(?:\s*([-/])\s*(\d{1,7}))?(?:\s*[a-z])?(?!\w)"
POSTAL_CODES = (
    r"(?<!\d)\d{5,6}(?!\d)",
    r"(?<![A-Z0-9])\d{5}-\d{4}(?!\d)",
    r"(?<![A-Z0-9])\d{3}\s?\d{2}(?!\d)",
    r"(?<![A-Z0-9])[A-Z]\d[A-Z]\s?\d[A-Z]\d(?!\w)",
)

#: Latin letters for the Brahmic scripts by a code point's place in its block of 128 (from U+0900 on).
BRAHMIC = {
    0x01: "n", 0x02: "m", 0x03: "h", 0x05: "a", 0x06: "aa", 0x07: "i", 0x08: "ii", 0x09: "u", 0x0A: "uu", 0x0B: "ri",
    0x0E: "e", 0x0F: "e", 0x10: "ai", 0x11: "o", 0x12: "o", 0x13: "au", 0x14: "au", 0x15: "k", 0x16: "kh", 0x17: "g",
    0x18: "gh", 0x19: "ng", 0x1A: "ch", 0x1B: "chh", 0x1C: "j", 0x1D: "jh", 0x1E: "ny", 0x1F: "t", 0x20: "th", 0x21: "d",
    0x22: "dh", 0x23: "n", 0x24: "t", 0x25: "th", 0x26: "d", 0x27: "dh", 0x28: "n", 0x2A: "p", 0x2B: "ph", 0x2C: "b",
    0x2D: "bh", 0x2E: "m", 0x2F: "y", 0x30: "r", 0x31: "r", 0x32: "l", 0x33: "l", 0x35: "v", 0x36: "sh", 0x37: "sh",
    0x38: "s", 0x39: "h", 0x3E: "aa", 0x3F: "i", 0x40: "ee", 0x41: "u", 0x42: "oo", 0x43: "ri", 0x47: "e", 0x48: "ai",
    0x4B: "o", 0x4C: "au", 0x58: "q", 0x59: "kh", 0x5A: "g", 0x5B: "z", 0x5C: "r", 0x5D: "rh", 0x5E: "f", 0x5F: "y",
}

#: Lower-case Cyrillic to Latin; capitals get a capital first letter. Signs and other letters vanish.
CYRILLIC = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "yo", "ж": "zh", "з": "z", "и": "i", "й": "y",
    "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f",
    "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ы": "y", "э": "e", "ю": "yu", "я": "ya",
}

# -- the older normaliser ---------------------------------------------------------------------

OLD_DOMAIN = r"\b(?:https?://)?(?:www\.)?([a-z0-9-]+)\.(?:com|org|net|in|fr|co|io|biz|info)\b"
OLD_ALIAS_MARKER = r"\b(?:aka|d/?b/?a|f/?k/?a|doing\s+business\s+as|formerly\s+known\s+as)\b"
OLD_LEGAL_WORDS = (
    "private limited", "pvt ltd", "pvt. ltd.", "pvt. ltd", "pvt limited", "co. ltd", "co. ltd.", "co ltd", "co limited",
    "& sons", "and sons", "& co", "and co", "et fils", "& fils", "limited", "private", "corporation", "incorporated",
    "corp.", "corp", "inc.", "inc", "llc.", "llc", "l.l.c.", "l.l.c", "ltd.", "ltd", "llp.", "llp", "sarl", "s.a.r.l.",
    "s.a.r.l", "sasu", "s.a.s.u.", "sas", "s.a.s.", "sci", "s.c.i.", "amicale", "groupe",
    "प्राइवेट लिमिटेड", "लिमिटेड", "प्राइवेट",
)
OLD_STREET_WORDS = {
    "rd": "road", "st": "street", "ave?": "avenue", "blvd": "boulevard", "dr": "drive", "ln": "lane", "pkwy": "parkway",
    "hwy": "highway", "fl": "floor", "ste": "suite", "apt": "apartment", "no": "number", "r": "rue", "bd": "boulevard",
    "all": "allee", "av": "avenue",
}
NAME_STOP_WORDS = (
    "limited", "private", "llc", "inc", "ltd", "pvt", "corp", "corporation", "services", "service", "center", "solutions",
    "enterprises", "enterprise", "international", "group", "holdings", "company", "and", "the", "for", "with",
    "लिमिटेड", "प्राइवेट", "कंपनी", "एंटरप्राइजेज", "sarl", "sasu", "sas", "sci", "sa", "amicale", "groupe", "france", "paris",
)
ADDRESS_STOP_WORDS = (
    "road", "street", "drive", "avenue", "lane", "court", "floor", "unit", "suite", "north", "south", "east", "west", "near",
    "delhi", "maharashtra", "karnataka", "texas", "california", "new", "number", "shop", "block", "sector", "india", "france",
    "states",
)

# -- secondary identity and evidence ------------------------------------------------------------

EMBEDDED_DOMAIN = r"(?<![A-Za-z0-9-])(?:https?://)?(?:www\.)?([A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?(?:\.[A-Za-z]{2,63})+)(?![A-Za-z0-9-])"
IDENTITY_ALIASES = (r"\b(?:dba|d/b/a|doing business as)\b\s*[:\-]?\s*(.+)$", r"\b(?:aka|a/k/a|also known as)\b\s*[:\-]?\s*(.+)$")
EVIDENCE_DOMAIN = r"^(?:https?://)?(?:www\.)?([^/:?#]+)"
