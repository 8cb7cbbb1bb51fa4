"""Word lists and lookup tables, each a parameter of the operators that use it. The defaults are fixed values."""

from __future__ import annotations

from dataclasses import dataclass, field

# Relations, and where disruption goes along an edge (forward: head to tail).
RELATIONS = ("supplier_of", "customer_of", "subsidiary_of", "competitor_of", "partner_of", "depends_on")
RISK_DIRECTIONS = {"supplier_of": "forward", "depends_on": "reverse", "customer_of": "reverse"}

# Who files, by ticker: the name that extractors use, the canonical name.
FILERS = {
    "LRCX": ("Lam Research", "Lam Research"),
    "AMAT": ("Applied Materials", "Applied Materials"),
    "KLAC": ("KLA Corporation", "KLA"),
    "MU": ("Micron Technology", "Micron"),
    "NVDA": ("NVIDIA", "NVIDIA"),
    "AMD": ("Advanced Micro Devices", "AMD"),
    "AVGO": ("Broadcom", "Broadcom"),
    "QCOM": ("Qualcomm", "Qualcomm"),
    "INTC": ("Intel", "Intel"),
}

# Words for the filing company, and words that are never an entity.
SELF_WORDS = ("we", "our", "us", "the company", "the corporation", "the firm", "company", "corporation")
SKIP_WORDS = ("that", "it", "they", "this", "which", "who", "its", "their", "he", "she", "a", "an", "the", "and", "or", "but")

# Relation, verbs, nouns, confidence of a verb and of a noun, is the subject the head, prepositions before the object.
TRIGGERS = (
    ("supplier_of", ("supply", "provide", "manufacture", "produce", "make", "deliver", "sell", "offer", "ship", "distribute", "fabricate"), ("supplier", "vendor", "manufacturer", "producer", "maker", "provider", "distributor", "foundry"), 0.75, 0.85, True, ("to", "for")),
    ("customer_of", ("purchase", "buy", "procure", "adopt", "utilize", "use", "source"), ("customer", "buyer", "purchaser", "client"), 0.70, 0.85, True, ("from", "of")),
    ("subsidiary_of", ("acquire", "own", "control", "absorb"), ("subsidiary", "division", "affiliate", "acquisition"), 0.65, 0.90, False, ("of",)),
    ("competitor_of", ("compete", "rival"), ("competitor", "rival", "competition"), 0.80, 0.80, True, ("against", "with", "of")),
    ("partner_of", ("partner", "collaborate", "cooperate", "team"), ("partner", "partnership", "alliance", "collaboration", "joint venture"), 0.72, 0.82, True, ("with", "of")),
    ("depends_on", ("depend", "rely", "hinge", "require"), ("dependence", "reliance", "dependency"), 0.78, 0.82, True, ("on",)),
)
PREPOSITIONS = ("with", "to", "from", "of", "on", "for", "against", "such")

# Patterns of text preparation and of relevance. A stem matches only as a whole word.
BANNER = r"=== ITEM \d+[A-Z]?:.*?==="
SENTENCE_END = r"(?<=[a-z0-9\"')])\.\s+(?=[A-Z\"])"
RELEVANT = ("suppli", "customer", "purchas", "partner", "subsidiar", "compet", "acqui", "depend", "rely", "manufactur", "vendor", "source", "client", "alliance", "joint venture")
JUNK_SPAN = r"(?i)\b(agreement|termination|amendment|whereby|schedule|exhibit|section|fiscal year|table of contents|10-K|form|report)\b"

# Canonical names and their variants (lower case; the key drops trailing .,; and blanks).
CANONICAL = {
    "TSMC": ("taiwan semiconductor manufacturing company limited", "taiwan semiconductor manufacturing company limited (tsmc)", "taiwan semiconductor manufacturing company", "taiwan semiconductor", "tsmc"),
    "NVIDIA": ("nvidia corporation", "nvidia corp", "nvidia", "nvda"),
    "AMD": ("advanced micro devices, inc", "advanced micro devices", "amd"),
    "Applied Materials": ("applied materials, inc", "applied materials", "applied"),
    "Lam Research": ("lam research corporation", "lam research corp", "lam research", "lam's", "lam"),
    "KLA": ("kla corporation", "kla corp", "kla-tencor", "kla's", "kla"),
    "Micron": ("micron technology, inc", "micron technology", "micron"),
    "Broadcom": ("broadcom corporation", "broadcom corp", "broadcom inc", "broadcom"),
    "Qualcomm": ("qualcomm incorporated", "qualcomm inc", "qualcomm"),
    "Intel": ("intel corporation", "intel corp", "intel"),
    "ASML": ("asml holding n.v", "asml holding", "asml"),
    "Samsung": ("samsung electronics co., ltd", "samsung electronics", "samsung", "samsung foundry"),
    "Microsoft": ("microsoft corporation", "microsoft", "xbox"),
    "Apple": ("apple inc", "apple"),
    "Sony": ("sony corporation", "sony", "sony interactive entertainment", "playstation"),
    "SoftBank": ("softbank group corp", "softbank group", "softbank"),
    "Arm": ("arm limited", "arm holdings", "arm holdings plc", "arm"),
    "GLOBALFOUNDRIES": ("globalfoundries inc", "globalfoundries inc. (gf)", "globalfoundries", "gf"),
    "UMC": ("united microelectronics corporation", "umc"),
    "SMIC": ("semiconductor manufacturing international corporation", "smic"),
    "VMware": ("vmware, inc", "vmware"),
    "Xilinx": ("xilinx, inc", "xilinx"),
    "Pensando Systems": ("pensando systems, inc", "pensando systems", "pensando"),
    "Dell": ("dell technologies", "dell inc", "dell"),
    "HPE": ("hewlett packard enterprise",),
    "HP": ("hewlett-packard", "hewlett-packard corp", "hp inc"),
    "Google": ("google llc", "google", "alphabet"),
    "AWS": ("amazon web services", "aws"),
    "Amazon": ("amazon",),
    "Meta": ("meta platforms", "meta", "facebook"),
    "Tokyo Electron": ("tokyo electron, ltd", "tokyo electron limited", "tokyo electron"),
    "Screen Holdings": ("screen holding co., ltd", "screen semiconductor solutions"),
    "Onto Innovation": ("onto innovation, inc", "onto innovation"),
    "Lasertec": ("lasertec, inc", "lasertec"),
    "Hitachi": ("hitachi high-technologies corporation", "hitachi high-tech", "hitachi"),
    "ASM International": ("asm international n.v", "asm international", "asmi"),
    "Flex": ("flex ltd", "flex limited", "flex"),
    "Amkor Technology": ("amkor technology, inc", "amkor technology", "amkor"),
    "Tongfu Microelectronics": ("tongfu microelectronics co., ltd", "tongfu microelectronics"),
    "Advantest": ("advantest corporation", "advantest america inc", "advantest"),
    "Chroma ATE": ("chroma ate inc", "chroma ate"),
    "Ibiden": ("ibiden co., ltd", "ibiden co", "ibiden"),
    "Western Digital": ("western digital corporation", "western digital"),
    "SanDisk": ("sandisk corporation", "sandisk"),
    "Huawei": ("huawei technologies co., ltd", "huawei technologies", "huawei"),
    "Novellus Systems": ("novellus systems, inc", "novellus systems", "novellus"),
    "LSI Logic": ("lsi logic corporation", "lsi logic"),
    "AT&T": ("at&t technologies", "at&t"),
    "Microchip Technology": ("microchip technology incorporated", "microchip technology", "microchip"),
    "Microsemi": ("microsemi corporation", "microsemi"),
    "IDT": ("integrated device technology, inc", "integrated device technology"),
    "Aruba Networks": ("aruba networks",),
    "CA Technologies": ("ca technologies",),
    "BYD Auto": ("byd auto", "byd"),
    "KYEC": ("kyec",),
    "Atlassian": ("atlassian corporation plc", "atlassian corporation", "atlassian"),
}
# Variants that are no company.
BLACKLIST = ("the assumed xilinx notes",)

# Anchors; one side of each kept relation is one of them.
ANCHORS = (
    "NVIDIA", "AMD", "Applied Materials", "Lam Research", "KLA", "Micron", "Broadcom", "Qualcomm", "Intel", "TSMC", "GLOBALFOUNDRIES", "UMC", "SMIC", "Samsung", "ASML", "Tokyo Electron", "ASM International", "Hitachi", "Advantest", "Lasertec", "Onto Innovation", "Screen Holdings", "Chroma ATE", "Amkor Technology", "Tongfu Microelectronics", "Flex", "Ibiden", "Microsoft", "Apple", "Dell", "HPE", "Sony", "IBM", "Google", "AWS", "Amazon", "Meta", "SoftBank", "Arm", "Xilinx", "VMware", "Pensando Systems", "Novellus Systems", "LSI Logic", "Microsemi", "IDT", "Atlassian", "CA Technologies", "Aruba Networks", "Western Digital", "SanDisk", "Huawei", "BYD Auto", "Microchip Technology", "AT&T", "KYEC",
)

# Names that are never an entity, by lower case.
NOISE = (
    "we", "us", "our", "the company", "company", "the corporation", "customers", "customer", "suppliers", "supplier", "vendors", "vendor", "foundries", "foundry", "partners", "partner", "competitors", "competitor", "third parties", "third party", "third-party", "a third party", "manufacturers", "manufacturer", "subcontractors", "original device manufacturers", "odms", "oems", "oem", "industry leaders", "start-ups", "governmental entities", "employees", "consultants", "retailers/distributors", "system builders", "semiconductor manufacturers", "our customers", "our suppliers", "outsource providers", "other service providers", "tier-1 automotive suppliers", "automotive manufacturers", "foundry/logic customers",
    "china", "taiwan", "germany", "singapore", "asia", "russia", "ukraine", "u.s.", "u.s. or foreign governments", "the united states", "the united states of america", "the european union", "the u.s. department", "the u.s. department of commerce", "the u.s. government", "the european commission",
    "gpu", "cpu", "ai", "cuda", "dram", "nand", "ssd", "hdd", "soc", "fpga", "asic", "rf", "gaas", "inp", "mems", "euv", "hbm", "geforce", "ryzen", "radeon", "hopper", "alveo",
    "2023", "3d", "•", "node", "covid-19", "software", "hardware", "moore's law", "pc supply chain", "data center", "labor", "assembly", "california", "lehi", "fort collins", "hong kong", "xinjiang", "board of directors", "board meetings", "sec", "esg",
    "customer opportunity", "dispose of businesses", "business combinations", "stock purchase plan", "repurchase program", "credit facility", "equity incentive plan", "long-term incentive plan",
    "distributors", "key distributors", "others", "non-us", "public sector", "tier 1", "incumbent competitors", "technology development partners", "coalition of technology companies", "hyperscale customer", "xpu", "5th gen", "black/african", "arizona", "oregon", "new mexico",
)

# Patterns that decide about names; all but the last ignore case.
PRONOUN = r"(<filing company>|filing company|the company|the corporation|we|us|our company|the registrant)"
JUNK = r"(•|–|—|\d[\d\s]*$|contents\s|the \w+ committee|the board\b|title age|notes\b|f-\d|segment technologies|we are subject|existing repurchase|publicly announced|internal control|financial statements|critical accounting|ir\.|[a-z]{1,3}\.[a-z]{2,}|scope \d|ras?u|ghg|pfas|fbar|sg&a|rd&e|rpo|nvm|wlp|ics|igp|stb|bios|the \w+ \w+ \w+ act|the \w+ \w+ \w+ regulation)"
GENERIC = r"(third.party|our |another |open source|public cloud|smaller companies|diversified|critical infra|internet and|mapping compan|providers of|companies that|major semiconductor|customers in|foundry.logic|more compan|other compan|new compan)"
PRODUCT = r"(AMD |NVIDIA |Intel |Qualcomm |Broadcom |Lam |KLA |Applied ).+"
SHORT_CAPITALS = r"[A-Z0-9]{1,4}"
# Exceptions to and additions of the name rules.
KNOWN_CAPITALS = ("AMD", "KLA", "IBM", "HPE", "UMC", "AWS", "IDT", "HP", "AT&T", "TSMC", "ASML", "SMIC", "KYEC", "BYD")
NO_PRODUCTS = ("AMD", "NVIDIA", "Intel", "Qualcomm", "Broadcom", "Lam Research", "KLA", "Applied Materials")
CATEGORIES = ("AIBs", "CMs", "IDMs", "ISVs", "OEMs", "ODMs", "JVs", "CSPs", "SoCs", "GPUs", "CPUs", "DPUs", "ASICs")
NOT_COMPANIES = (
    "Stanford University", "Moore's Law", "Moody's Investors Service", "Responsible Business Alliance", "Revolving Credit Facility", "VMware Merger", "Ethereum", "Wi-Fi", "H.264", "ISO 45001", "FactSet financial data", "Seshasayee", "Field Programmable Gate Arrays", "Data Over Cable Service Interface Specifications", "Identity & Access Management", "Employee Health and Safety", "Employee Resource Groups", "Employees' Stock Purchase Plan", "Integration Risks Acquisitions", "Licenses Protection", "Decline", "Augmented", "DevOps", "FC SAN", "Coreware", "GPU Cloud", "GeForce NOW", "GNSS semiconductor", "NVIDIA AI Enterprise", "NVIDIA Omniverse", "NVIDIA's partner network", "Customer Semiconductor", "Consolidated Financial Statements", "Ultimate", "WRX80", "ASC 805", "Xi'an", "ATMP JVs", "Open System Foundry", "RAMP-C", "Smart Capital", "IDM 2.0", "Scale IDM 2.0", "AI PC Acceleration Program", "Argonne National Laboratory", "Bain Capital", "IMS Nanofabrication", "MLCommons", "McAfee", "SolarWinds Corporation", "Stability AI", "Mobileye Class", "Mobileye SuperVision", "SuperVision",
)


@dataclass(frozen=True)
class Lexicon:
    """What name resolution and merging look up. Defaults are the fixed values above."""

    canonical: dict[str, str | None] = field(default_factory=lambda: {k: c for c, keys in CANONICAL.items() for k in keys} | dict.fromkeys(BLACKLIST))
    filers: dict[str, str] = field(default_factory=lambda: {t: names[1] for t, names in FILERS.items()})
    anchors: tuple[str, ...] = ANCHORS
    noise: tuple[str, ...] = NOISE
    relations: tuple[str, ...] = RELATIONS
    junk: str = JUNK
    generic: str = GENERIC
    product: str = PRODUCT
    not_companies: tuple[str, ...] = NOT_COMPANIES
