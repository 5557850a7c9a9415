"""Word lists, look-up tables, weights and thresholds that the results depend on."""

# Mail domains of persons, and those where dots in the local part don't count.
PERSONAL_DOMAINS = [
    "gmail.com", "googlemail.com", "yahoo.com", "yahoo.co.in", "yahoo.co.uk", "outlook.com", "hotmail.com", "hotmail.co.uk", "live.com", "msn.com",
    "icloud.com", "me.com", "mac.com", "proton.me", "protonmail.com", "aol.com", "gmx.com", "zoho.com", "hey.com", "fastmail.com",
]
DOTLESS_DOMAINS = ["gmail.com", "googlemail.com"]

# Legal forms at the end of company names (dotted spellings can't occur after cleaning).
LEGAL_FORMS = [
    "private limited", "pvt ltd", "pvt", "limited", "ltd", "llc", "inc", "incorporated", "corp", "corporation", "co", "gmbh", "bv", "plc", "llp",
    "technologies", "technology", "labs", "laboratories", "studios",
]

# Abbreviations in titles, expanded word by word ("v p" before the words are taken apart).
TITLE_WORDS = {
    "vp": "vice president", "svp": "senior vice president", "evp": "executive vice president", "avp": "associate vice president", "sr": "senior", "jr": "junior",
    "dir": "director", "mgr": "manager", "gp": "general partner", "ceo": "chief executive officer", "cto": "chief technology officer",
    "coo": "chief operating officer", "cfo": "chief financial officer", "cpo": "chief product officer", "cmo": "chief marketing officer",
    "gm": "general manager", "revops": "revenue operations", "ops": "operations", "eng": "engineering", "cos": "chief of staff",
}

# Titles that mean a role, in the order in which they are tried.
TITLE_ROLES = {
    "founder": "founder", "co founder": "founder", "cofounder": "founder",
    "founder and chief executive officer": "founder_ceo", "co founder and chief executive officer": "founder_ceo", "cofounder and chief executive officer": "founder_ceo",
    "chief executive officer and founder": "founder_ceo", "chief executive officer and co founder": "founder_ceo",
    "founder and chief technology officer": "founder_cto", "co founder and chief technology officer": "founder_cto", "cofounder and chief technology officer": "founder_cto",
    "founder and chief operating officer": "founder_coo", "co founder and chief operating officer": "founder_coo", "cofounder and chief operating officer": "founder_coo",
    "founder and chief product officer": "founder_cpo",
    "chief executive officer": "ceo", "chief technology officer": "cto", "chief operating officer": "coo",
    "chief of staff": "chief_of_staff", "chief of staff to the chief executive officer": "chief_of_staff",
    "head of growth": "head_of_growth", "growth lead": "head_of_growth", "head of product": "head_of_product", "product lead": "head_of_product",
    "head of customer success": "head_of_customer_success", "customer success lead": "head_of_customer_success", "head of people": "head_of_people",
    "general partner": "general_partner", "managing partner": "managing_partner", "partner": "partner", "principal": "principal", "angel investor": "angel_investor",
    "director of revenue operations": "director_revops", "staff software engineer": "staff_engineer", "staff engineer": "staff_engineer",
    "principal engineer": "principal_engineer", "solutions architect": "solutions_architect",
    "fractional chief financial officer": "fractional_cfo", "fractional chief marketing officer": "fractional_cmo",
}

# Parts of names that don't count.
HONORIFICS = ["mr", "mrs", "ms", "miss", "dr", "prof", "professor", "sir", "madam", "shri", "smt", "sri", "er", "ca"]
NAME_SUFFIXES = ["jr", "sr", "ii", "iii", "iv", "phd", "mba", "md"]

# Spellings of cities, and the countries of known ones.
CITY_NAMES = {
    "bangalore": "bengaluru", "bombay": "mumbai", "gurgaon": "delhi ncr", "gurugram": "delhi ncr", "new delhi": "delhi ncr", "dxb": "dubai", "nyc": "new york",
    "new york city": "new york", "sf": "san francisco", "sf bay area": "san francisco", "bay area": "san francisco", "london uk": "london",
}
CITY_COUNTRY = {
    "bengaluru": "India", "mumbai": "India", "delhi ncr": "India", "hyderabad": "India", "pune": "India", "chennai": "India", "singapore": "Singapore",
    "dubai": "United Arab Emirates", "london": "United Kingdom", "berlin": "Germany", "amsterdam": "Netherlands", "paris": "France",
    "san francisco": "United States", "new york": "United States", "austin": "United States", "toronto": "Canada", "sydney": "Australia",
    "sao paulo": "Brazil", "lagos": "Nigeria", "tokyo": "Japan",
}

# Weights of completeness in hundredths, in order; labels; what blocks a record and the sentence for it.
FIELD_WEIGHTS = {"email": 20, "linkedin_url": 15, "company": 15, "title": 15, "bio": 15, "location": 10, "needs_offers": 10}
FIELD_LABELS = {"email": "email", "linkedin_url": "LinkedIn", "company": "company", "title": "title", "bio": "bio", "location": "location", "needs_offers": "needs or offers"}
BLOCKED_EMAIL = "Can't send an intro — no email on file"
BLOCKED_COMPANY = "Can't judge fit or filter out colleagues — no company on file"
BLOCKED_BOTH = "Can't send an intro or judge fit — no email or company on file"

# Thresholds and weights of pair scoring and routing.
MERGE_AT, ESCALATE_AT, NAME_CAP, NAME_LEAST, INITIAL_SCORE = 92.0, 78.0, 91.0, 90.0, 95.0
NAME_WEIGHT, COMPANY_WEIGHT, TITLE_BONUS, TITLE_PENALTY = 0.65, 0.35, 3.0, 2.0
MAX_BUCKET, PREFIX = 40, 3

# Closed lists of enrichment, and the fields a quote may cite.
ENUMS = {
    "persona": ["founder", "operator", "investor", "service_provider", "ic", "unknown"],
    "seniority": ["founder", "c_level", "vp", "director", "head_or_lead", "senior_ic", "mid", "junior", "unknown"],
    "company_stage": ["pre_seed", "seed", "series_a", "series_b", "growth", "public", "not_applicable", "unknown"],
    "sector": ["b2b_saas", "fintech", "healthtech", "climate", "devtools", "ecommerce", "marketplace", "ai_infra", "cybersecurity", "logistics", "edtech", "consumer", "investing", "services", "other", "unknown"],
    "geography": ["india", "south_east_asia", "middle_east", "europe", "north_america", "latin_america", "africa", "apac", "unknown"],
}
CITABLE = ["full_name", "email", "linkedin_url", "company", "title", "location", "bio", "needs", "offers"]
MIN_QUOTE, LOW_CONFIDENCE, MAX_PHRASES, MAX_EVIDENCE = 4, 0.5, 5, 8

# Points of the rubric, bands, and the pattern of a concrete claim.
PERSONA_POINTS = {"founder": 30, "operator": 20, "investor": 14, "service_provider": 10, "ic": 8, "unknown": 6}
SENIORITY_POINTS = {"c_level": 20, "founder": 18, "vp": 16, "director": 13, "head_or_lead": 12, "senior_ic": 9, "mid": 5, "junior": 2, "unknown": 4}
STAGE_POINTS = {"growth": 20, "public": 19, "series_b": 18, "series_a": 15, "seed": 10, "pre_seed": 5, "not_applicable": 12, "unknown": 6}
REFERRAL_POINTS = {"member": 15, "unknown_referrer": 8, "none": 4}
COMPONENTS = {"persona_fit": 30, "seniority": 20, "company_stage": 20, "referral_signal": 15, "profile_signal": 15}
PROFILE_MAX, TRACTION_POINTS, CONTRIBUTION_POINTS = 8, 4, 3
STRONG, REVIEW = 75, 55
TRACTION = r"(?i)(\d[\d,.]*\s*(?:crore|lakh|cr|k|m|mn|million|%)|[$₹]\s*\d|\d+\s*(?:customers|people|users|employees|accounts|pilots))"
PERSONA_SIGNALS = {
    "founder": "founder — the network's core persona", "operator": "senior operator, not a founder", "investor": "investor rather than an operator",
    "service_provider": "sells services into the network", "ic": "individual contributor — not who this network is for",
    "unknown": "persona could not be determined from the record",
}
STAGE_SIGNALS = {"not_applicable": "no company stage applies to this role", "unknown": "company stage not stated anywhere in the record"}
REFERRAL_SIGNALS = {"none": "applied cold, no referral", "member": "referred by an existing member", "unknown_referrer": "referrer named but not found in the network"}

# Thresholds and weights of matching; stages in order, neighbours being adjacent; reasons in the order in which they are tried.
PRIMARY_WEIGHT, SECOND_WEIGHT, SIMILARITY_WEIGHT, RECIPROCITY_BONUS = 0.60, 0.15, 0.10, 0.15
RECIPROCITY_FLOOR, MIN_DIRECTION, MIN_SCORE, CAPACITY, COMPLETENESS_FLOOR = 0.62, 0.68, 0.55, 3, 0.50
STAGE_ORDER = ["pre_seed", "seed", "series_a", "series_b", "growth"]
REASONS = ["same_company", "competitors", "incomplete_profile", "blocked_pair", "already_introduced", "no_shared_signal"]
