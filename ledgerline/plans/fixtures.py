"""Small inline inputs for rules that find nothing in the driver's tables, and what they must give."""

URLS = ["https://a.legistar.com/Calendar.aspx", "https://B.Granicus.com/x", "https://www.civicplusmedia.com/", "http://c.iqm2.com", "https://example.org/none"]

DIGEST_SCHEMA = "text_id string, text string, known_item_numbers array<string>, people array<struct<raw_name:string,role:string>>"
_GOOD = "# City digest\n\n## Overview\n\nTwo items were heard.\n\n## Consent Calendar\n\nThe council approved a fee of $500 (Item 2.1).\n"
DIGESTS = [
    ("good", _GOOD, ["2.1"], []),
    ("headless", "Some text.\n\n## Reports\n\nA report.", [], []),
    ("order", "# T\n\n## Reports\n\nOne.\n\n## Overview\n\nTwo.\n\n## Extra\n\nThree.", [], []),
    ("citation", "# T\n\n## Overview\n\nThey spent $9 today.\n\n## Reports\n\nIt was $40 in all. The plan passed (Item 9.9).", ["1.1"], []),
    ("banned", "# T\n\n## Overview\n\nYou are welcomed! Of course it was a historic day.", [], []),
    ("long", "# T\n\n## Overview\n\n" + "word " * 151 + "end.", [], []),
    ("names", "# T\n\n## Overview\n\nDoan spoke first. Mayor Mahan spoke. Then Councilmember Doan left.", [], [("Matt Mahan", "mayor"), ("Bien Doan", "councilmember"), ("Jo Roe", "staff")]),
    ("dense", "# T\n\n## Overview\n\nInstitutional reorganization necessitates comprehensive intergovernmental accountability.", [], []),
]
#: text, rule, severity, findings
EXPECTED_FINDINGS = [
    ("headless", "missing_header", "high", 1), ("headless", "missing_overview", "high", 1),
    ("order", "section_order", "medium", 1), ("order", "unexpected_section", "low", 1),
    ("citation", "unknown_citation", "high", 1), ("citation", "missing_citation", "high", 1),
    ("banned", "banned_construction", "medium", 4), ("banned", "banned_construction", "low", 1),
    ("long", "paragraph_too_long", "low", 1), ("long", "sentence_too_long", "low", 1), ("long", "reading_level", "low", 1),
    ("names", "missing_first_reference_title", "medium", 1),
    ("dense", "reading_level", "low", 1),
]

RULE_CASES = [(["a", "b"], ["a", "c"]), (["a"], ["a"]), ([], ["c"]), (["b"], [])]
RULE_COUNTS = [("a", 2, 0, 0), ("b", 0, 0, 2), ("c", 0, 2, 0)]

AMOUNTS = [("1000000", "1000000", True), ("1000000", "2000000", False), ("10.001", "10.005", True), ("abc", "10", False), ("1e6", "1000000.0", True)]
NAMES = [("Mayor Mahan", "mahan"), ("Vice Mayor Foley", "foley"), ("Mahan", "mahan"), ("  Council  Member Jo ROE ", "jo roe"), ("Mayor Vice Mayor X", "vice mayor x"), ("Chairman Po", "chairman po")]

_P = '{"raw_name": "%s", "role": "mayor"}'
GOLD = [("c1", "people", 0, _P % "Ann Lee"), ("c1", "people", 1, _P % "Ann Lee"), ("c2", "amounts", 0, '{"raw_text": "$1M", "amount_usd": "1000000"}')]
PREDICTED = [("c1", "people", 0, _P % "Mayor Ann Lee"), ("c2", "amounts", 0, '{"raw_text": "one million", "amount_usd": "1000000"}'), ("c2", "amounts", 1, '{"raw_text": "$2M", "amount_usd": "2000000"}')]

CATEGORIES = [
    ("city council", "planning commission", "1", 0), ("city council", "city council", "2", 1), ("city council", "city council study session", "3", 2),
    ("town board", "town board meetings", "4", 0), ("town board", "town council", "5", 1), ("assembly", "council of elders", "6", 0), ("nothing", "parks", "7", 0),
]
CATEGORY_ANSWERS = [("city council", "2"), ("town board", "4"), ("assembly", "6"), ("nothing", None)]
