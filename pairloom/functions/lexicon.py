"""Word lists and lookup tables of the normalisers. They are fixed values: results depend on them word for word."""

# Legal forms and their canonical spelling.
LEGAL = {
    "inc": "inc", "incorporated": "inc", "llc": "llc", "pllc": "pllc", "llp": "llp", "lp": "lp",
    "corp": "corp", "corporation": "corp", "co": "co", "company": "co", "ltd": "ltd", "limited": "ltd",
    "pvt": "pvt", "private": "pvt", "pc": "pc", "plc": "plc", "opc": "opc", "pa": "pa",
    "sarl": "sarl", "sas": "sas", "sasu": "sasu", "sa": "sa", "sci": "sci", "snc": "snc", "eurl": "eurl",
    "scop": "scop", "selarl": "selarl", "cie": "cie", "gmbh": "gmbh",
    "pra": "pvt", "prai": "pvt", "li": "ltd", "lim": "ltd", "pvtltd": "pvt",
}
# Words without weight in a name.
FILLER = ("the", "and", "of", "a", "an", "dba", "de", "la", "le", "les", "du", "des", "et", "l", "d")
# Street words and their canonical spelling.
STREET = {
    "street": "st", "st": "st", "str": "st", "saint": "st", "sreet": "st", "stree": "st",
    "road": "rd", "rd": "rd", "avenue": "ave", "ave": "ave", "av": "ave", "drive": "dr", "dr": "dr",
    "lane": "ln", "ln": "ln", "boulevard": "blvd", "blvd": "blvd", "bd": "blvd", "bld": "blvd",
    "court": "ct", "ct": "ct", "place": "pl", "pl": "pl", "circle": "cir", "cir": "cir",
    "highway": "hwy", "hwy": "hwy", "parkway": "pkwy", "pkwy": "pkwy", "terrace": "ter", "ter": "ter",
    "trail": "trl", "trl": "trl", "square": "sq", "sq": "sq", "way": "way", "pike": "pike",
    "north": "n", "south": "s", "east": "e", "west": "w", "n": "n", "s": "s", "e": "e", "w": "w",
    "apartment": "apt", "apt": "apt", "suite": "ste", "ste": "ste", "unit": "unit", "floor": "fl", "fl": "fl",
    "number": "no", "no": "no", "nos": "no", "door": "no", "plot": "plot", "near": "near", "opp": "opp",
    "opposite": "opp", "behind": "behind", "nagar": "nagar", "ngr": "nagar", "marg": "marg", "mg": "marg",
    "colony": "colony", "sector": "sector", "sec": "sector", "phase": "phase", "ph": "phase",
    "rue": "rue", "r": "rue", "allee": "allee", "all": "allee", "chemin": "chemin", "ch": "chemin",
    "impasse": "impasse", "imp": "impasse", "route": "rte", "rte": "rte", "quai": "quai", "cours": "cours",
    "faubourg": "fbg", "fbg": "fbg", "residence": "res", "res": "res", "lieu": "lieu", "dit": "dit",
}
# Canonical street types.
STREET_TYPES = ("st", "rd", "ave", "dr", "ln", "blvd", "ct", "pl", "cir", "hwy", "pkwy", "ter", "trl", "sq", "way", "pike", "rue", "allee", "chemin", "impasse", "rte", "quai", "cours", "fbg", "marg")
# Words of a street component that belong to no street name.
STREET_EXTRAS = ("no", "plot", "apt", "ste", "unit", "fl")
# Words that are no part of a city's name.
CITY_NOISE = ("city", "county", "township", "ownship", "cdp", "region", "district", "dist", "corporation", "hq", "town", "village", "municipality", "mandal", "tehsil", "taluk", "division")
# States and regions by country.
STATES = {
    "us": {
        "alabama": "al", "alaska": "ak", "arizona": "az", "arkansas": "ar", "california": "ca", "colorado": "co",
        "connecticut": "ct", "delaware": "de", "florida": "fl", "georgia": "ga", "hawaii": "hi", "idaho": "id",
        "illinois": "il", "indiana": "in", "iowa": "ia", "kansas": "ks", "kentucky": "ky", "louisiana": "la",
        "maine": "me", "maryland": "md", "massachusetts": "ma", "michigan": "mi", "minnesota": "mn",
        "mississippi": "ms", "missouri": "mo", "montana": "mt", "nebraska": "ne", "nevada": "nv",
        "new hampshire": "nh", "new jersey": "nj", "new mexico": "nm", "new york": "ny", "north carolina": "nc",
        "north dakota": "nd", "ohio": "oh", "oklahoma": "ok", "oregon": "or", "pennsylvania": "pa",
        "rhode island": "ri", "south carolina": "sc", "south dakota": "sd", "tennessee": "tn", "texas": "tx",
        "utah": "ut", "vermont": "vt", "virginia": "va", "washington": "wa", "west virginia": "wv",
        "wisconsin": "wi", "wyoming": "wy", "district of columbia": "dc", "puerto rico": "pr",
    },
    "india": {
        "andhra pradesh": "ap", "arunachal pradesh": "ar", "assam": "as", "bihar": "br", "chhattisgarh": "cg",
        "chattisgarh": "cg", "ct": "cg", "goa": "ga", "gujarat": "gj", "haryana": "hr", "himachal pradesh": "hp",
        "jharkhand": "jh", "karnataka": "ka", "kerala": "kl", "keralam": "kl", "madhya pradesh": "mp",
        "maharashtra": "mh", "manipur": "mn", "meghalaya": "ml", "mizoram": "mz", "nagaland": "nl",
        "odisha": "od", "orissa": "od", "or": "od", "punjab": "pb", "rajasthan": "rj", "sikkim": "sk",
        "tamil nadu": "tn", "telangana": "tg", "ts": "tg", "tripura": "tr", "uttar pradesh": "up",
        "uttarakhand": "uk", "uttaranchal": "uk", "ut": "uk", "west bengal": "wb", "delhi": "dl",
        "new delhi": "dl", "nct of delhi": "dl", "jammu and kashmir": "jk", "jammu kashmir": "jk",
        "ladakh": "la", "chandigarh": "ch", "puducherry": "py", "pondicherry": "py",
        "andaman and nicobar islands": "an", "dadra and nagar haveli": "dn", "daman and diu": "dd",
        "lakshadweep": "ld",
    },
    "france": {
        "ile de france": "idf", "hauts de france": "hdf", "nouvelle aquitaine": "naq", "pays de la loire": "pdl",
        "bretagne": "bre", "normandie": "nor", "grand est": "ges", "occitanie": "occ", "bourgogne franche comte": "bfc",
        "auvergne rhone alpes": "ara", "provence alpes cote d azur": "pac", "centre val de loire": "cvl", "corse": "cor",
        "nord": "hdf", "pas de calais": "hdf", "somme": "hdf", "aisne": "hdf", "oise": "hdf",
        "gironde": "naq", "landes": "naq", "dordogne": "naq", "lot et garonne": "naq", "pyrenees atlantiques": "naq",
        "charente": "naq", "charente maritime": "naq", "deux sevres": "naq", "vienne": "naq", "haute vienne": "naq",
        "correze": "naq", "creuse": "naq",
        "loire atlantique": "pdl", "maine et loire": "pdl", "mayenne": "pdl", "sarthe": "pdl", "vendee": "pdl",
        "paris": "idf",
    },
}
# States that share one blocking partition.
STATE_GROUPS = {"tg": "ap", "dc": "wa"}
# Digits that stand for letters within a word.
LEET_FROM, LEET_TO = "0134578", "oleastb"
# Top-level domains of the name normaliser's domain form.
DOMAINS = ("com", "in", "net", "org", "co", "io", "biz", "fr", "us", "info", r"co\.in")
# Patterns of the normalisers: marks that separate words, the domain form of a name, the dot of an acronym, what separates tokens.
JUNK = r'[<>#*~^|=_+"`]+'
DOMAIN = rf"^(?:www\.)?([a-z0-9\-]+)\.({'|'.join(DOMAINS)})\b"
ACRONYM_DOT = r"(?<=\b[a-z])\.(?=[a-z]\b)"
SEPARATORS = r"\s,.;:()\[\]\-/#"
# Learned words that stand for part of a state's name only.
STATE_WORDS = {"bengal": "west bengal", "nadu": "tamil nadu"}
# Greek and Cyrillic letters whose Latin form does not follow from how their names begin.
LETTERS = {"THETA": "th", "PHI": "f", "CHI": "ch", "PSI": "ps", "ETA": "i", "IE": "e", "IO": "yo", "YU": "yu", "YA": "ya", "HA": "kh", "GHE": "g", "YERU": "y", "SHORT I": "i", "HARD SIGN": "", "SOFT SIGN": "", "SHCHA": "shch"}
# Signs of Indic scripts.
SIGNS = {"VIRAMA": "", "NUKTA": "", "ANUSVARA": "n", "CANDRABINDU": "n", "BINDI": "n", "TIPPI": "n", "VISARGA": "h", "ADDAK": "", "AVAGRAHA": ""}
