"""Lookup tables, word lists and constants that results depend on.

They are plain text so that they can be read, checked and swapped. Every operator takes
its table as a parameter and uses the one here only as the default.
"""

from __future__ import annotations


# --- Fixed values: state number -> ISO 3166-1 alpha-3 code. ---
STATE_CODES = {
    2: "USA", 20: "CAN", 40: "CUB", 41: "HTI", 42: "DOM", 70: "MEX", 90: "GTM", 91: "HND",
    92: "SLV", 93: "NIC", 94: "CRI", 95: "PAN", 100: "COL", 101: "VEN", 110: "GUY", 115: "SUR", 130: "ECU",
    135: "PER", 140: "BRA", 145: "BOL", 150: "PRY", 155: "CHL", 160: "ARG", 165: "URY", 200: "GBR", 205: "IRL",
    210: "NLD", 211: "BEL", 212: "LUX", 220: "FRA", 225: "CHE", 230: "ESP", 235: "PRT", 260: "DEU", 290: "POL",
    305: "AUT", 310: "HUN", 315: "CZE", 316: "CZE", 317: "SVK", 325: "ITA", 339: "ALB", 341: "MNE",
    343: "MKD", 344: "HRV", 345: "SRB", 346: "BIH", 347: "KOS", 349: "SVN", 350: "GRC", 352: "CYP", 355: "BGR",
    359: "MDA", 360: "ROU", 365: "RUS", 366: "EST", 367: "LVA", 368: "LTU", 369: "UKR", 370: "BLR", 371: "ARM",
    372: "GEO", 373: "AZE", 375: "FIN", 380: "SWE", 385: "NOR", 390: "DNK", 395: "ISL", 402: "CPV", 404: "GNB",
    411: "GNQ", 420: "GMB", 432: "MLI", 433: "SEN", 434: "BEN", 435: "MRT", 436: "NER", 437: "CIV", 438: "GIN",
    439: "BFA", 450: "LBR", 451: "SLE", 452: "GHA", 461: "TGO", 471: "CMR", 475: "NGA", 481: "GAB", 482: "CAF",
    483: "TCD", 484: "COG", 490: "COD", 500: "UGA", 501: "KEN", 510: "TZA", 516: "BDI", 517: "RWA", 520: "SOM",
    522: "SOM", 530: "ETH", 531: "ERI", 540: "AGO", 541: "MOZ", 551: "ZMB", 552: "ZWE", 553: "MWI", 560: "ZAF",
    565: "NAM", 570: "LSO", 571: "BWA", 572: "SWZ", 580: "MDG", 581: "COM", 590: "MUS", 600: "MAR", 615: "DZA",
    616: "TUN", 620: "LBY", 625: "SDN", 626: "SSD", 630: "IRN", 640: "TUR", 645: "IRQ", 651: "EGY", 652: "SYR",
    660: "LBN", 663: "JOR", 666: "ISR", 670: "SAU", 678: "YEM", 680: "YEM", 690: "KWT", 692: "BHR", 694: "QAT",
    696: "ARE", 698: "OMN", 700: "AFG", 701: "TKM", 702: "TJK", 703: "KGZ", 704: "UZB", 705: "KAZ", 710: "CHN",
    712: "MNG", 713: "TWN", 731: "PRK", 732: "KOR", 740: "JPN", 750: "IND", 760: "BTN", 770: "PAK", 771: "BGD",
    775: "MMR", 780: "LKA", 781: "MDV", 790: "NPL", 800: "THA", 811: "KHM", 812: "LAO", 816: "VNM", 820: "MYS",
    830: "SGP", 835: "BRN", 840: "PHL", 850: "IDN", 860: "TLS", 900: "AUS", 910: "PNG", 920: "NZL", 940: "SLB",
    950: "FJI", 51: "JAM", 52: "TTO", 338: "MLT",
}

# --- Fixed values: country name as written in event records -> code. ---
EVENT_COUNTRY_NAMES = [
    ("Afghanistan", "AFG"), ("Algeria", "DZA"), ("Angola", "AGO"), ("Azerbaijan", "AZE"), ("Bangladesh", "BGD"),
    ("Burundi", "BDI"), ("Cambodia", "KHM"), ("Cameroon", "CMR"), ("Central African Republic", "CAF"),
    ("Chad", "TCD"), ("Colombia", "COL"), ("Congo", "COG"), ("DR Congo (Zaire)", "COD"),
    ("Democratic Republic of Congo", "COD"), ("Djibouti", "DJI"), ("Egypt", "EGY"), ("Eritrea", "ERI"),
    ("Ethiopia", "ETH"), ("Georgia", "GEO"), ("Ghana", "GHA"), ("Guatemala", "GTM"), ("Guinea", "GIN"),
    ("Guinea-Bissau", "GNB"), ("Haiti", "HTI"), ("India", "IND"), ("Indonesia", "IDN"), ("Iran", "IRN"),
    ("Iraq", "IRQ"), ("Israel", "ISR"), ("Ivory Coast", "CIV"), ("Jamaica", "JAM"), ("Kenya", "KEN"),
    ("Lebanon", "LBN"), ("Liberia", "LBR"), ("Libya", "LBY"), ("Mali", "MLI"), ("Malta", "MLT"),
    ("Mauritania", "MRT"), ("Mexico", "MEX"), ("Mozambique", "MOZ"), ("Myanmar (Burma)", "MMR"),
    ("Nepal", "NPL"), ("Nicaragua", "NIC"), ("Niger", "NER"), ("Nigeria", "NGA"), ("Pakistan", "PAK"),
    ("Papua New Guinea", "PNG"), ("Peru", "PER"), ("Philippines", "PHL"), ("Russia (Soviet Union)", "RUS"),
    ("Rwanda", "RWA"), ("Senegal", "SEN"), ("Sierra Leone", "SLE"), ("Somalia", "SOM"), ("South Africa", "ZAF"),
    ("South Sudan", "SSD"), ("Sri Lanka", "LKA"), ("Sudan", "SDN"), ("Syria", "SYR"), ("Tajikistan", "TJK"),
    ("Thailand", "THA"), ("Trinidad and Tobago", "TTO"), ("Turkey", "TUR"), ("Uganda", "UGA"),
    ("Ukraine", "UKR"), ("United States", "USA"), ("Venezuela", "VEN"), ("Yemen (North Yemen)", "YEM"),
    ("Zimbabwe", "ZWE"),
]

# --- Fixed values: X in "Government of X" -> code. ---
GOVERNMENT_NAMES = [
    ("Afghanistan", "AFG"), ("Algeria", "DZA"), ("Angola", "AGO"), ("Australia", "AUS"), ("Azerbaijan", "AZE"),
    ("Bahrain", "BHR"), ("Bangladesh", "BGD"), ("Benin", "BEN"), ("Bosnia-Herzegovina", "BIH"),
    ("Brazil", "BRA"), ("Burkina Faso", "BFA"), ("Burundi", "BDI"), ("Cambodia (Kampuchea)", "KHM"),
    ("Cambodia", "KHM"), ("Cameroon", "CMR"), ("Central African Republic", "CAF"), ("Chad", "TCD"),
    ("China", "CHN"), ("Colombia", "COL"), ("Comoros", "COM"), ("Congo", "COG"), ("Croatia", "HRV"),
    ("DR Congo (Zaire)", "COD"), ("Democratic Republic of Congo", "COD"), ("Djibouti", "DJI"),
    ("Ecuador", "ECU"), ("Egypt", "EGY"), ("El Salvador", "SLV"), ("Eritrea", "ERI"), ("Ethiopia", "ETH"),
    ("Gambia", "GMB"), ("Georgia", "GEO"), ("Ghana", "GHA"), ("Guatemala", "GTM"), ("Guinea", "GIN"),
    ("Guinea-Bissau", "GNB"), ("Haiti", "HTI"), ("India", "IND"), ("Indonesia", "IDN"), ("Iran", "IRN"),
    ("Iraq", "IRQ"), ("Israel", "ISR"), ("Ivory Coast", "CIV"), ("Jamaica", "JAM"), ("Jordan", "JOR"),
    ("Kenya", "KEN"), ("Kuwait", "KWT"), ("Kyrgyzstan", "KGZ"), ("Laos", "LAO"), ("Lebanon", "LBN"),
    ("Lesotho", "LSO"), ("Liberia", "LBR"), ("Libya", "LBY"), ("Madagascar", "MDG"), ("Malaysia", "MYS"),
    ("Mali", "MLI"), ("Malta", "MLT"), ("Mauritania", "MRT"), ("Mexico", "MEX"), ("Moldova", "MDA"),
    ("Morocco", "MAR"), ("Mozambique", "MOZ"), ("Myanmar (Burma)", "MMR"), ("Nepal", "NPL"),
    ("Nicaragua", "NIC"), ("Niger", "NER"), ("Nigeria", "NGA"), ("North Macedonia", "MKD"), ("Pakistan", "PAK"),
    ("Panama", "PAN"), ("Papua New Guinea", "PNG"), ("Paraguay", "PRY"), ("Peru", "PER"),
    ("Philippines", "PHL"), ("Romania", "ROU"), ("Russia (Soviet Union)", "RUS"), ("Rwanda", "RWA"),
    ("Senegal", "SEN"), ("Serbia (Yugoslavia)", "SRB"), ("Sierra Leone", "SLE"), ("Somalia", "SOM"),
    ("South Africa", "ZAF"), ("South Sudan", "SSD"), ("Spain", "ESP"), ("Sri Lanka", "LKA"), ("Sudan", "SDN"),
    ("Syria", "SYR"), ("Tajikistan", "TJK"), ("Tanzania", "TZA"), ("Thailand", "THA"), ("Togo", "TGO"),
    ("Trinidad and Tobago", "TTO"), ("Tunisia", "TUN"), ("Turkey", "TUR"), ("Uganda", "UGA"),
    ("Ukraine", "UKR"), ("United Kingdom", "GBR"), ("United States", "USA"),
    ("United States of America", "USA"), ("Uzbekistan", "UZB"), ("Venezuela", "VEN"),
    ("Yemen (North Yemen)", "YEM"), ("Zimbabwe", "ZWE"), ("Zimbabwe (Rhodesia)", "ZWE"),
    ("eSwatini (Swaziland)", "SWZ"),
]

# --- Fixed values: code -> display name. ---
DISPLAY_NAMES = {
    "AFG": "Afghanistan", "AGO": "Angola", "ALB": "Albania", "ARE": "United Arab Emirates", "ARG": "Argentina",
    "ARM": "Armenia", "AUS": "Australia", "AUT": "Austria", "AZE": "Azerbaijan", "BDI": "Burundi",
    "BEL": "Belgium", "BEN": "Benin", "BFA": "Burkina Faso", "BGD": "Bangladesh", "BHR": "Bahrain",
    "BIH": "Bosnia and Herzegovina", "BLR": "Belarus", "BOL": "Bolivia", "BRA": "Brazil", "BRN": "Brunei",
    "BTN": "Bhutan", "BWA": "Botswana", "CAF": "Central African Republic", "CAN": "Canada",
    "CHE": "Switzerland", "CHL": "Chile", "CHN": "China", "CIV": "Ivory Coast", "CMR": "Cameroon",
    "COD": "Democratic Republic of the Congo", "COG": "Republic of the Congo", "COL": "Colombia",
    "COM": "Comoros", "CPV": "Cape Verde", "CRI": "Costa Rica", "CUB": "Cuba", "CYP": "Cyprus",
    "CZE": "Czech Republic", "DEU": "Germany", "DJI": "Djibouti", "DNK": "Denmark", "DOM": "Dominican Republic",
    "DZA": "Algeria", "ECU": "Ecuador", "EGY": "Egypt", "ERI": "Eritrea", "ESP": "Spain", "EST": "Estonia",
    "ETH": "Ethiopia", "FIN": "Finland", "FJI": "Fiji", "FRA": "France", "GAB": "Gabon",
    "GBR": "United Kingdom", "GEO": "Georgia", "GHA": "Ghana", "GIN": "Guinea", "GMB": "Gambia",
    "GNB": "Guinea-Bissau", "GNQ": "Equatorial Guinea", "GRC": "Greece", "GTM": "Guatemala", "GUY": "Guyana",
    "HND": "Honduras", "HRV": "Croatia", "HTI": "Haiti", "HUN": "Hungary", "IDN": "Indonesia", "IND": "India",
    "IRL": "Ireland", "IRN": "Iran", "IRQ": "Iraq", "ISL": "Iceland", "ISR": "Israel", "ITA": "Italy",
    "JAM": "Jamaica", "JOR": "Jordan", "JPN": "Japan", "KAZ": "Kazakhstan", "KEN": "Kenya", "KGZ": "Kyrgyzstan",
    "KHM": "Cambodia", "KOR": "South Korea", "KOS": "Kosovo", "KWT": "Kuwait", "LAO": "Laos", "LBN": "Lebanon",
    "LBR": "Liberia", "LBY": "Libya", "LKA": "Sri Lanka", "LSO": "Lesotho", "LTU": "Lithuania",
    "LUX": "Luxembourg", "LVA": "Latvia", "MAR": "Morocco", "MDA": "Moldova", "MDG": "Madagascar",
    "MDV": "Maldives", "MEX": "Mexico", "MKD": "North Macedonia", "MLI": "Mali", "MLT": "Malta",
    "MMR": "Myanmar", "MNE": "Montenegro", "MNG": "Mongolia", "MOZ": "Mozambique", "MRT": "Mauritania",
    "MUS": "Mauritius", "MWI": "Malawi", "MYS": "Malaysia", "NAM": "Namibia", "NER": "Niger", "NGA": "Nigeria",
    "NIC": "Nicaragua", "NLD": "Netherlands", "NOR": "Norway", "NPL": "Nepal", "NZL": "New Zealand",
    "OMN": "Oman", "PAK": "Pakistan", "PAN": "Panama", "PER": "Peru", "PHL": "Philippines",
    "PNG": "Papua New Guinea", "POL": "Poland", "PRK": "North Korea", "PRT": "Portugal", "PRY": "Paraguay",
    "QAT": "Qatar", "ROU": "Romania", "RUS": "Russia", "RWA": "Rwanda", "SAU": "Saudi Arabia", "SDN": "Sudan",
    "SEN": "Senegal", "SGP": "Singapore", "SLB": "Solomon Islands", "SLE": "Sierra Leone", "SLV": "El Salvador",
    "SOM": "Somalia", "SRB": "Serbia", "SSD": "South Sudan", "SUR": "Suriname", "SVK": "Slovakia",
    "SVN": "Slovenia", "SWE": "Sweden", "SWZ": "Eswatini", "SYR": "Syria", "TCD": "Chad", "TGO": "Togo",
    "THA": "Thailand", "TJK": "Tajikistan", "TKM": "Turkmenistan", "TLS": "Timor-Leste",
    "TTO": "Trinidad and Tobago", "TUN": "Tunisia", "TUR": "Turkey", "TWN": "Taiwan", "TZA": "Tanzania",
    "UGA": "Uganda", "UKR": "Ukraine", "USA": "United States", "URY": "Uruguay", "UZB": "Uzbekistan",
    "VEN": "Venezuela", "VNM": "Vietnam", "YEM": "Yemen", "ZAF": "South Africa", "ZMB": "Zambia",
    "ZWE": "Zimbabwe",
}

# --- Fixed values: headline gazetteer, term -> code. Phrases (with a space) are tried first,
# --- in this order; the order also decides ties between single words.
GAZETTEER = [
    ("ukraine", "UKR"), ("ukrainian", "UKR"), ("kyiv", "UKR"), ("kiev", "UKR"), ("russia", "RUS"),
    ("russian", "RUS"), ("moscow", "RUS"), ("kremlin", "RUS"), ("sudan", "SDN"), ("sudanese", "SDN"),
    ("khartoum", "SDN"), ("darfur", "SDN"), ("south sudan", "SSD"), ("juba", "SSD"), ("israel", "ISR"),
    ("israeli", "ISR"), ("jerusalem", "ISR"), ("tel aviv", "ISR"), ("palestine", "PSE"), ("palestinian", "PSE"),
    ("gaza", "PSE"), ("west bank", "PSE"), ("syria", "SYR"), ("syrian", "SYR"), ("damascus", "SYR"),
    ("aleppo", "SYR"), ("yemen", "YEM"), ("yemeni", "YEM"), ("sanaa", "YEM"), ("houthi", "YEM"),
    ("lebanon", "LBN"), ("lebanese", "LBN"), ("beirut", "LBN"), ("hezbollah", "LBN"), ("iran", "IRN"),
    ("iranian", "IRN"), ("tehran", "IRN"), ("iraq", "IRQ"), ("iraqi", "IRQ"), ("baghdad", "IRQ"),
    ("somalia", "SOM"), ("somali", "SOM"), ("mogadishu", "SOM"), ("al-shabaab", "SOM"), ("congo", "COD"),
    ("drc", "COD"), ("kinshasa", "COD"), ("nigeria", "NGA"), ("nigerian", "NGA"), ("abuja", "NGA"),
    ("boko haram", "NGA"), ("mali", "MLI"), ("malian", "MLI"), ("bamako", "MLI"), ("burkina faso", "BFA"),
    ("ouagadougou", "BFA"), ("niger", "NER"), ("niamey", "NER"), ("ethiopia", "ETH"), ("ethiopian", "ETH"),
    ("addis ababa", "ETH"), ("tigray", "ETH"), ("afghanistan", "AFG"), ("afghan", "AFG"), ("kabul", "AFG"),
    ("taliban", "AFG"), ("pakistan", "PAK"), ("pakistani", "PAK"), ("islamabad", "PAK"), ("india", "IND"),
    ("indian", "IND"), ("new delhi", "IND"), ("kashmir", "IND"), ("china", "CHN"), ("chinese", "CHN"),
    ("beijing", "CHN"), ("taiwan", "TWN"), ("taiwanese", "TWN"), ("taipei", "TWN"), ("myanmar", "MMR"),
    ("burma", "MMR"), ("burmese", "MMR"), ("yangon", "MMR"), ("naypyidaw", "MMR"), ("colombia", "COL"),
    ("colombian", "COL"), ("bogota", "COL"), ("mexico", "MEX"), ("mexican", "MEX"), ("mexico city", "MEX"),
    ("haiti", "HTI"), ("haitian", "HTI"), ("port-au-prince", "HTI"), ("armenia", "ARM"), ("armenian", "ARM"),
    ("yerevan", "ARM"), ("azerbaijan", "AZE"), ("azerbaijani", "AZE"), ("baku", "AZE"),
    ("nagorno-karabakh", "AZE"), ("united states", "USA"), ("us", "USA"), ("american", "USA"),
    ("washington", "USA"), ("pentagon", "USA"),
]

# --- Fixed values: publisher country name (lower case) -> code. ---
PUBLISHER_COUNTRIES = [
    ("united states", "USA"), ("united kingdom", "GBR"), ("russia", "RUS"), ("china", "CHN"), ("france", "FRA"),
    ("germany", "DEU"), ("india", "IND"), ("israel", "ISR"), ("ukraine", "UKR"), ("sudan", "SDN"),
    ("syria", "SYR"), ("yemen", "YEM"), ("nigeria", "NGA"), ("colombia", "COL"), ("mexico", "MEX"),
    ("indonesia", "IDN"), ("pakistan", "PAK"), ("turkey", "TUR"), ("egypt", "EGY"), ("south africa", "ZAF"),
    ("brazil", "BRA"), ("canada", "CAN"), ("australia", "AUS"), ("japan", "JPN"), ("kenya", "KEN"),
    ("ethiopia", "ETH"), ("somalia", "SOM"), ("afghanistan", "AFG"), ("iraq", "IRQ"), ("iran", "IRN"),
    ("lebanon", "LBN"), ("algeria", "DZA"), ("taiwan", "TWN"), ("myanmar", "MMR"), ("thailand", "THA"),
]

# --- Fixed values: nine-category taxonomy. Order decides ties for the primary category. ---
TAXONOMY = {
    "armed_conflict": [
        "war", "battle", "clash", "troops", "fighting", "combat", "shelling", "airstrike", "bombardment",
        "artillery", "offensive", "assault",
    ],
    "violence_civilian": [
        "massacre", "civilian deaths", "atrocities", "execution", "casualties", "deadly attack", "civilians killed",
        "hostage",
    ],
    "military_escalation": [
        "missile test", "mobilization", "naval deployment", "military drill", "troop buildup", "air defense",
        "warplanes", "weapons shipment",
    ],
    "ceasefire_peace": [
        "ceasefire", "truce", "peace talks", "armistice", "peace negotiation", "peace agreement", "peace deal",
    ],
    "sanctions_economic": [
        "sanctions", "embargo", "trade restriction", "asset freeze", "economic penalties", "boycott",
    ],
    "displacement_refugees": [
        "refugees", "displaced", "asylum seekers", "fleeing", "humanitarian crisis", "refugee camp",
    ],
    "terrorism_insurgency": [
        "terrorist", "suicide bomber", "insurgency", "ambush", "guerrilla", "rebel group", "militants", "jihadist",
    ],
    "border_tensions": [
        "border clash", "border skirmish", "disputed border", "airspace violation", "border standoff",
        "territorial dispute",
    ],
    "diplomatic_escalation": [
        "ambassador recalled", "diplomatic expulsion", "severed ties", "ultimatum", "security treaty",
        "diplomatic crisis",
    ],
}

# --- Fixed values: word valences in [-1, 1]. ---
VALENCES = {
    "war": -0.8, "massacre": -1.0, "killed": -0.8, "deadly": -0.8, "fatal": -0.8, "death": -0.7, "crisis": -0.6,
    "threat": -0.6, "escalate": -0.6, "attack": -0.7, "bombing": -0.8, "missile": -0.5, "clash": -0.6,
    "fighting": -0.6, "terrorist": -0.9, "atrocity": -0.9, "collapse": -0.7, "danger": -0.6, "hostile": -0.6,
    "siege": -0.7, "sanctions": -0.5, "casualty": -0.7, "wound": -0.5, "refugee": -0.4, "displaced": -0.4,
    "flee": -0.5, "destroy": -0.7, "aggression": -0.7, "invasion": -0.8, "strike": -0.6, "peace": 0.8,
    "ceasefire": 0.7, "truce": 0.7, "agreement": 0.6, "reconciliation": 0.7, "talks": 0.3, "treaty": 0.6,
    "diplomacy": 0.5, "stability": 0.6, "cooperation": 0.6, "aid": 0.4, "relief": 0.5, "recovery": 0.5,
    "dialogue": 0.4, "compromise": 0.5, "settlement": 0.5, "progress": 0.5, "resolve": 0.4, "protection": 0.5,
    "humanitarian": 0.3,
}

# --- Fixed values: violence types. ---
VIOLENCE_TYPES = {1: "state_based", 2: "non_state", 3: "one_sided"}

# --- Fixed values: formats and patterns. ---
ARTICLE_TIME_FORMATS = (
    "yyyyMMdd'T'HHmmss'Z'",
    "yyyyMMddHHmmss",
    "yyyyMMdd",
    "yyyy-M-d H:m:s",
    "yyyy-M-d",
)
GOVERNMENT_MARKER = "Government of"
GOVERNMENT_PATTERN = r"Government of ([^,;\n]+)"
TOKEN_PATTERN = r"(?U)\b[a-z\-]+\b"
WHITE_SPACE = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# --- Fixed values: panel and feature constants. ---
LAGS = (1, 2, 3, 6, 12)
WINDOWS = (3, 6, 12)
ACTIVE_THRESHOLD = 25
GROWTH_BOUND = 10.0

# --- Fixed values: tone, escalation and tension constants. ---
NEGATIVE_TONE = -0.2
EXTREME_TONE = 0.6
PHRASE_CONFIDENCE, WORD_CONFIDENCE, SHORT_WORD_CONFIDENCE = 0.95, 0.9, 0.75
ESCALATION_WEIGHTS = (0.4, 0.3, 0.3)
TENSION_WEIGHTS = (0.6, 0.4)
FATALITY_SCALE = 1000.0
BLOODLESS_TENSION = 0.25

# --- Fixed values: graph constants. ---
PAGERANK_ALPHA, PAGERANK_MAX_ITER, PAGERANK_TOL = 0.85, 100, 1e-6
HYBRID_BACK_BASELINE = 0.5
HYBRID_BACK_COUNTERFACTUAL = 0.7
HYBRID_BACK_PROPAGATION = 0.5

# --- Fixed values: what-if constants and archetypes. ---
DEFAULT_DEPTH, DEFAULT_DECAY = 2, 0.5
TONE_TO_TENSION, NEWS_TO_TENSION = 0.5, 0.2
NEWS_TO_ESCALATION, TONE_TO_ESCALATION = 0.2, 0.3
ARRIVAL_TONE_CAP = 0.4
MIN_SEED = 1e-4
# archetype, tone_delta, conflict_news_multiplier, sever_dyadic_tie, decay_factor, propagation_depth
ARCHETYPES = [
    ("diplomatic_escalation", -0.4, 1.5, False, 0.5, 2),
    ("sanctions_severance", -0.3, 1.2, True, 0.4, 2),
    ("military_mobilization", -0.6, 2.0, False, 0.6, 2),
    ("ceasefire_deescalation", 0.5, 0.3, False, 0.5, 2),
]

# --- Fixed values: risk outlook. Horizon days -> factor, any other horizon -> OTHER_HORIZON. ---
HORIZON_FACTORS = {30: -3, 90: 2, 180: 6}
OTHER_HORIZON = 9
# domain, share of the horizon factor, lower clamp, upper clamp
OUTLOOK_DOMAINS = [
    ("escalation", 1.0, 20, 96),
    ("conflict", 0.8, 18, 98),
    ("economy", 0.6, 15, 95),
    ("energy", 0.7, 15, 95),
    ("global_impact", 0.9, 20, 97),
]
# domain, lower bound (inclusive), status
STATUS_BANDS = [
    ("conflict", 80, "Critical"), ("conflict", 65, "Elevated"),
    ("conflict", 45, "Moderate"), ("conflict", None, "Guarded"),
    ("economy", 75, "High Volatility"), ("economy", 50, "Moderate Exposure"), ("economy", None, "Stable"),
    ("energy", 75, "Acute Disruption"), ("energy", 50, "Tight Supply"), ("energy", None, "Resilient"),
    ("global_impact", 75, "Systemic Risk"), ("global_impact", 55, "Regional Spillover"),
    ("global_impact", None, "Localized"),
    ("overview", 75, "high"), ("overview", 55, "medium"), ("overview", None, "low"),
    ("hotspot", 85, "critical"), ("hotspot", 75, "elevated"), ("hotspot", None, "normal"),
]
# domain, score from which the driver counts as "high" (else "medium")
DRIVER_THRESHOLDS = [("conflict", 70), ("economy", 65), ("energy", 70), ("global_impact", 70)]
# step order, label, step factor
FAN_STEPS = [(0, "Now", 0.0), (1, "30D", 0.25), (2, "60D", 0.5), (3, "90D", 0.75), (4, "180D", 1.0), (5, "365D", 1.25)]
# name, points below the conflict score
SUB_SCORES = [("political", 6), ("border", 12), ("cyber", 18)]
SUB_SCORE_CAP = 95
TOP_IMPORTANCES = 16

# --- Fixed values: linear factor stress. ---
STRESS_BASE_RETURN, STRESS_BASE_DOWNSIDE, STRESS_BASE_LEVEL = 0.68, 41.6, 25014.60
# factor, effect on return per unit, effect on downside probability per unit
STRESS_SENSITIVITIES = [
    ("gpr", -0.0018, 0.15),
    ("oil", -0.095, 1.25),
    ("gold", -0.040, 0.75),
    ("fx", -0.220, 2.8),
]
STRESS_DOWNSIDE_RANGE = (8.0, 95.0)
# shock id, gpr, oil, gold, fx
STRESS_PRESETS = [
    ("war_escalation", 150.0, 16.5, 6.8, 1.8),
    ("hormuz_blockade", 120.0, 28.5, 5.4, 2.2),
    ("de_escalation", -45.0, -8.5, -3.2, -0.8),
    ("taiwan_tensions", 135.0, 7.2, 8.5, 2.6),
]

# --- Fixed values: classifier. ---
WARNING_THRESHOLD = 50
SPLIT_SEED, TRAIN_PERCENT = 42, 80
RISK_LABELS = {1: "High Escalation Risk", 0: "Normal / Low Risk"}

# --- Fixed values: columns of raw and clean tables. ---
RAW_EVENT_COLUMNS = (
    "id", "year", "type_of_violence", "conflict_name", "side_a", "side_b", "country", "country_id",
    "region", "date_start", "date_end", "best", "high", "low", "deaths_civilians", "latitude", "longitude",
)
RAW_ARTICLE_COLUMNS = (
    "url", "url_mobile", "title", "seendate", "socialimage", "domain", "language", "sourcecountry",
)
CLEAN_EVENT_COLUMNS = (
    "id", "country_iso3", "country", "country_id", "region", "event_date", "event_year", "event_month",
    "year_month", "type_of_violence", "violence_type_label", "conflict_name", "side_a", "side_b",
    "best", "high", "low", "deaths_civilians", "latitude", "longitude",
)
COUNT_COLUMNS = ("best", "high", "low", "deaths_civilians", "deaths_a", "deaths_b")

# --- Fixed values: forms of dates in raw events besides ISO text. The first that fits counts. ---
EVENT_DATE_FORMATS = ("M/d/yyyy", "M-d-yyyy", "yyyy/M/d", "yyyyMMdd", "d MMM yyyy", "MMM d, yyyy", "d MMMM yyyy", "MMMM d, yyyy", "d.M.yyyy")
