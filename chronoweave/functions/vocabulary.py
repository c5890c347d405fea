"""Closed vocabularies.

Fixed values: everything in this file is a list, order or constant that results depend on.
"""

RELATIONS = ("BEFORE", "CONTAINS", "SIMULTANEOUS", "OVERLAP", "BEGINS-ON", "ENDS-ON")
SYMMETRIC = ("SIMULTANEOUS", "BEGINS-ON")
MAJORITY = "BEFORE"
KINDS = ("EE", "ET", "TE", "TT")
LAYERS = ("ONT", "ARG", "DISC", "LEX", "TIME", "GRAPH")
WEAK_KINDS = ("CAUSE", "PRECONDITION", "SUBEVENT")
ANCHORABLE = ("DATE", "TIME")
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
PREPOSITIONS = tuple("in on at during since until till by after before from to between throughout within for of around early late mid following prior about when while as".split())
CONNECTIVES = tuple(
    "after before during while when whilst until till since following then later afterwards afterward subsequently meanwhile as amid amidst prior eventually finally"
    " previously earlier once upon throughout and but thereafter soon immediately simultaneously whereupon".split()
)
BEGIN_WORDS = (
    r"^(begin|began|begun|beginning|begins|start|started|starting|starts|launch\w*|open\w*|found(ed|ing)?|establish\w*|commenc\w*|initiat\w*|inaugurat\w*|creat\w*|form(ed|ation)?|outbreak|onset"
    r"|broke|erupt\w*|develop\w*|emerg\w*|introduc\w*|debut\w*|premier\w*|kick\w*)$"
)
END_WORDS = (
    r"^(end|ended|ending|ends|finish\w*|conclu\w*|terminat\w*|clos\w*|ceas\w*|dissolv\w*|dissolution|dissipat\w*|abolish\w*|surrender\w*|disband\w*|expir\w*|culminat\w*|halt\w*|stop\w*"
    r"|lift\w*|withdr\w*|retir\w*|died|death|collaps\w*|over)$"
)
DURATION_WORDS = (
    r"^(last\w*|continu\w*|remain\w*|span\w*|run|ran|running|persist\w*|stay\w*|rul\w*|reign\w*|serv\w*|lived|occup\w*|war|wars|campaign|period|season|era|tour|festival|siege|rebellion"
    r"|conflict|struggle|revolution|dynasty|held|took)$"
)
_MONTH_WORD = r"\b(" + "|".join((*MONTHS, *(m[:3] for m in MONTHS), "sept")) + r")\b"
_YEAR_WORD, _DAY_WORD = r"\b\d{3,4}\b", r"\b\d{1,2}(st|nd|rd|th)?\b"
_UNIT = r"\b(second|minute|hour|day|night|week|month|year|decade|centur)"
_QUANTITY = (
    r"\b(\d+|a|an|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|fifteen|twenty|thirty|forty|fifty|hundred|several|few|many|some|nearly|about|almost|over|the next|the following"
    r"|the previous|the past|the last|more)\b|-(day|year|week|month|hour)"
)
#: Shapes of time expressions: a trimmed lower-case text has the first shape all of whose patterns it holds, else OTHER.
SHAPES = (
    ("TIME", (r"\d{1,2}:\d{2}|utc|gmt|\ba\.?m\b|\bp\.?m\b|o'clock|noon|midnight",)),
    ("DECADE_CENT", (r"centur|\b\d{3,4}s\b",)),
    ("YEAR_RANGE", (r"^\d{1,4}\s*([–—\-~]|to)\s*\d{1,4}( (bc|bce|ad|ce))?$",)),
    ("DAY_RANGE", (r"\d\s*[–—\-]\s*\d", "jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec")),
    ("YEAR", (r"^\d{3,4}( (bc|bce|ad|ce))?$|^(ad|ce) \d{1,4}$",)),
    ("BARE_NUM", (r"^\d{1,2}$",)),
    ("FULL_DATE", (_MONTH_WORD, _YEAR_WORD, _DAY_WORD)),
    ("MONTH_YEAR", (_MONTH_WORD, _YEAR_WORD)),
    ("DAY_MONTH", (_MONTH_WORD, _DAY_WORD)),
    ("MONTH", (_MONTH_WORD,)),
    ("REL_QTY", (_UNIT, _QUANTITY, r"\b(later|after|ago|before|earlier|previous|following|next|past|last)\b")),
    ("QTY", (_UNIT, _QUANTITY)),
    ("RELATIVE", (r"^(the |that |this |same |its )|\b(same|following|previous|next|time|then|now|today|yesterday)\b",)),
    ("HAS_YEAR", (_YEAR_WORD,)),
)
Z_TEXTBOOK, Z_EXACT = 1.96, 1.959963985
#: The Allen relations that each label allows.
ALLEN_OF = {
    "BEFORE": ("b",),
    "CONTAINS": ("di",),
    "OVERLAP": ("o",),
    "SIMULTANEOUS": ("e",),
    "BEGINS-ON": ("s", "si", "e"),
    "ENDS-ON": ("b", "m"),
}
ALLEN = ("b", "bi", "m", "mi", "o", "oi", "s", "si", "d", "di", "f", "fi", "e")
CONVERSE = {"b": "bi", "bi": "b", "m": "mi", "mi": "m", "o": "oi", "oi": "o", "s": "si", "si": "s", "d": "di", "di": "d", "f": "fi", "fi": "f", "e": "e"}
