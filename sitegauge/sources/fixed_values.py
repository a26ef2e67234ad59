"""Lookup tables whose contents are given, not computed.

Everything below is a fixed value: the numbers, codes, names and word lists
must stay as they are for scores to come out right, in the order in which
lookups consider them.
"""

# State abbreviation and two-digit state code.
STATES = [
    ("AL", "01"),
    ("AK", "02"),
    ("AZ", "04"),
    ("AR", "05"),
    ("CA", "06"),
    ("CO", "08"),
    ("CT", "09"),
    ("DE", "10"),
    ("FL", "12"),
    ("GA", "13"),
    ("HI", "15"),
    ("ID", "16"),
    ("IL", "17"),
    ("IN", "18"),
    ("IA", "19"),
    ("KS", "20"),
    ("KY", "21"),
    ("LA", "22"),
    ("ME", "23"),
    ("MD", "24"),
    ("MA", "25"),
    ("MI", "26"),
    ("MN", "27"),
    ("MS", "28"),
    ("MO", "29"),
    ("MT", "30"),
    ("NE", "31"),
    ("NV", "32"),
    ("NH", "33"),
    ("NJ", "34"),
    ("NM", "35"),
    ("NY", "36"),
    ("NC", "37"),
    ("ND", "38"),
    ("OH", "39"),
    ("OK", "40"),
    ("OR", "41"),
    ("PA", "42"),
    ("RI", "44"),
    ("SC", "45"),
    ("SD", "46"),
    ("TN", "47"),
    ("TX", "48"),
    ("UT", "49"),
    ("VT", "50"),
    ("VA", "51"),
    ("WA", "53"),
    ("WV", "54"),
    ("WI", "55"),
    ("WY", "56"),
]

# Counties in scope, with 2023 population.
COUNTY_POPULATIONS = [
    ("51107", 434741),
    ("51059", 1150309),
    ("51153", 495601),
    ("51013", 238643),
    ("48113", 2613539),
    ("48439", 2110640),
    ("48029", 2088159),
    ("41065", 27317),
    ("41013", 25076),
    ("19155", 93791),
    ("04013", 4496588),
    ("37183", 1175021),
    ("37063", 332680),
    ("13121", 1066677),
    ("13089", 764382),
    ("39049", 1323807),
    ("39035", 1264817),
    ("18097", 990987),
    ("53025", 100621),
    ("53033", 2269675),
    ("17031", 5275541),
    ("17043", 932877),
    ("32003", 2265461),
    ("45083", 327997),
    ("47037", 715884),
    ("49035", 1185238),
]

# County code, latitude and longitude of its centroid.
CENTROIDS = [
    ("51107", 39.08, -77.64),
    ("51059", 38.83, -77.28),
    ("51153", 38.69, -77.48),
    ("48113", 32.77, -96.77),
    ("48439", 32.76, -97.29),
    ("48029", 29.45, -98.52),
    ("41065", 45.16, -121.17),
    ("41013", 44.29, -120.83),
    ("19155", 41.34, -95.54),
    ("04013", 33.35, -112.49),
    ("37183", 35.79, -78.64),
    ("13121", 33.79, -84.39),
    ("39049", 39.97, -82.99),
    ("18097", 39.78, -86.15),
    ("53025", 47.2, -119.52),
    ("17031", 41.84, -87.82),
    ("32003", 36.22, -115.27),
    ("45083", 34.94, -81.99),
    ("47037", 36.17, -86.78),
    ("49035", 40.67, -111.93),
]

# Place alias and its candidate counties, most prominent first.
PLACE_ALIASES = [
    ("nova", ("51059", "51107", "51153", "51013")),
    ("northern virginia", ("51059", "51107", "51153", "51013")),
    ("data center alley", ("51107",)),
    ("ashburn", ("51107",)),
    ("manassas", ("51153",)),
    ("sterling", ("51107",)),
    ("leesburg", ("51107",)),
    ("chantilly", ("51059",)),
    ("reston", ("51059",)),
    ("herndon", ("51059",)),
    ("the dalles", ("41065",)),
    ("prineville", ("41013",)),
    ("hillsboro", ("41067",)),
    ("boardman", ("41049",)),
    ("dfw", ("48113", "48439")),
    ("san antonio", ("48029",)),
    ("fort worth", ("48439",)),
    ("garland", ("48113",)),
    ("plano", ("48085",)),
    ("midlothian", ("48139",)),
    ("council bluffs", ("19155",)),
    ("west des moines", ("19153",)),
    ("altoona", ("19153",)),
    ("mesa", ("04013",)),
    ("goodyear", ("04013",)),
    ("chandler", ("04013",)),
    ("tempe", ("04013",)),
    ("scottsdale", ("04013",)),
    ("surprise", ("04013",)),
    ("durham", ("37063",)),
    ("raleigh", ("37183",)),
    ("research triangle", ("37063", "37183")),
    ("rtp", ("37063", "37183")),
    ("atlanta", ("13121",)),
    ("douglasville", ("13097",)),
    ("columbus", ("39049",)),
    ("new albany", ("39049",)),
    ("hilliard", ("39049",)),
    ("indianapolis", ("18097",)),
    ("indy", ("18097",)),
    ("quincy", ("53025",)),
    ("moses lake", ("53025",)),
    ("seattle", ("53033",)),
    ("chicago", ("17031",)),
    ("elk grove village", ("17031",)),
    ("mt. prospect", ("17031",)),
    ("mount prospect", ("17031",)),
    ("las vegas", ("32003",)),
    ("henderson", ("32003",)),
    ("reno", ("32031",)),
    ("spartanburg", ("45083",)),
    ("nashville", ("47037",)),
    ("clarksville", ("47125",)),
    ("salt lake city", ("49035",)),
    ("slc", ("49035",)),
    ("west jordan", ("49035",)),
    ("loudoun", ("51107",)),
    ("loudoun county", ("51107",)),
    ("prince william", ("51153",)),
    ("pw county", ("51153",)),
    ("fairfax", ("51059",)),
    ("fairfax county", ("51059",)),
    ("maricopa", ("04013",)),
    ("maricopa county", ("04013",)),
    ("cook county", ("17031",)),
]

# County name, state and county code.
COUNTY_NAMES = [
    ("loudoun county", "VA", "51107"),
    ("fairfax county", "VA", "51059"),
    ("prince william county", "VA", "51153"),
    ("arlington county", "VA", "51013"),
    ("fauquier county", "VA", "51061"),
    ("stafford county", "VA", "51179"),
    ("dallas county", "TX", "48113"),
    ("tarrant county", "TX", "48439"),
    ("bexar county", "TX", "48029"),
    ("collin county", "TX", "48085"),
    ("ellis county", "TX", "48139"),
    ("denton county", "TX", "48121"),
    ("wasco county", "OR", "41065"),
    ("crook county", "OR", "41013"),
    ("washington county", "OR", "41067"),
    ("morrow county", "OR", "41049"),
    ("pottawattamie county", "IA", "19155"),
    ("polk county", "IA", "19153"),
    ("maricopa county", "AZ", "04013"),
    ("pinal county", "AZ", "04021"),
    ("wake county", "NC", "37183"),
    ("durham county", "NC", "37063"),
    ("fulton county", "GA", "13121"),
    ("dekalb county", "GA", "13089"),
    ("douglas county", "GA", "13097"),
    ("franklin county", "OH", "39049"),
    ("cuyahoga county", "OH", "39035"),
    ("marion county", "IN", "18097"),
    ("hamilton county", "IN", "18057"),
    ("grant county", "WA", "53025"),
    ("king county", "WA", "53033"),
    ("cook county", "IL", "17031"),
    ("dupage county", "IL", "17043"),
    ("will county", "IL", "17197"),
    ("clark county", "NV", "32003"),
    ("washoe county", "NV", "32031"),
    ("spartanburg county", "SC", "45083"),
    ("davidson county", "TN", "47037"),
    ("montgomery county", "TN", "47125"),
    ("salt lake county", "UT", "49035"),
    ("utah county", "UT", "49049"),
]

# Forum name (lower case) and the state it speaks for.
FORUM_STATES = [
    ("virginia", "VA"),
    ("nova", "VA"),
    ("northernvirginia", "VA"),
    ("loudouncounty", "VA"),
    ("oregon", "OR"),
    ("portland", "OR"),
    ("texas", "TX"),
    ("dallas", "TX"),
    ("sanantonio", "TX"),
    ("iowa", "IA"),
    ("arizona", "AZ"),
    ("phoenix", "AZ"),
    ("northcarolina", "NC"),
    ("georgia", "GA"),
    ("atlanta", "GA"),
    ("ohio", "OH"),
    ("indiana", "IN"),
    ("seattle", "WA"),
    ("washington", "WA"),
    ("chicago", "IL"),
    ("illinois", "IL"),
    ("lasvegas", "NV"),
    ("nevada", "NV"),
    ("nashville", "TN"),
    ("tennessee", "TN"),
    ("utah", "UT"),
    ("saltlakecity", "UT"),
    ("southcarolina", "SC"),
]

# Mentions that name the whole country and never a place in it.
COUNTRY_NAMES = [
    "us",
    "usa",
    "u.s.",
    "u.s.a.",
    "america",
    "united states",
]

# Domain term and its valence.
DOMAIN_LEXICON = [
    ("moratorium", -2.5),
    ("oppose", -2.0),
    ("opposed", -2.0),
    ("opposition", -2.0),
    ("protest", -2.0),
    ("protesting", -2.0),
    ("protesters", -1.5),
    ("noise pollution", -2.5),
    ("water shortage", -3.0),
    ("water usage", -1.5),
    ("brownout", -2.0),
    ("blackout", -2.0),
    ("grid strain", -2.0),
    ("power outage", -2.0),
    ("outages", -1.5),
    ("eyesore", -2.0),
    ("destroy", -2.0),
    ("ruining", -2.5),
    ("petition", -1.5),
    ("lawsuit", -2.0),
    ("block", -1.0),
    ("blocked", -1.5),
    ("denied", -1.5),
    ("rejected", -1.5),
    ("environmental impact", -1.0),
    ("tax break", -0.5),
    ("tax incentive", -0.3),
    ("property value", -1.0),
    ("property values", -1.0),
    ("congestion", -1.0),
    ("traffic", -0.5),
    ("construction noise", -1.5),
    ("generator noise", -2.0),
    ("diesel generators", -1.5),
    ("zoning change", -0.5),
    ("rezoning", -0.5),
    ("jobs", 1.5),
    ("employment", 1.5),
    ("economic development", 1.5),
    ("investment", 1.0),
    ("revenue", 1.0),
    ("tax revenue", 1.0),
    ("infrastructure improvement", 1.5),
    ("broadband", 1.0),
    ("modernize", 1.0),
]

# Words that say nothing about a topic in this domain.
DOMAIN_STOP_WORDS = [
    "data",
    "center",
    "centers",
    "data center",
    "data centers",
    "server",
    "servers",
    "server farm",
    "facility",
    "facilities",
    "company",
    "companies",
    "build",
    "building",
    "project",
    "said",
    "would",
    "could",
    "also",
    "people",
    "like",
    "just",
    "really",
    "think",
    "know",
    "going",
]

# Topic label and the keywords that point to it, first label wins ties.
TOPIC_KEYWORDS = [
    ("Noise / Quality of Life", ("noise", "loud", "sound", "quiet", "residential", "neighborhood", "quality life")),
    ("Water Consumption", ("water", "drought", "consumption", "gallons", "aquifer", "shortage", "cooling")),
    ("Power Grid Strain", ("power", "grid", "electricity", "energy", "outage", "brownout", "blackout", "strain")),
    ("Property Values / Land Use", ("property", "home", "value", "housing", "land", "zoning", "residential", "real estate")),
    ("Tax Incentive Fairness", ("tax", "incentive", "subsidy", "break", "revenue", "taxpayer", "abatement", "deal")),
    ("Environmental Impact", ("environment", "climate", "carbon", "emissions", "pollution", "green", "sustainable")),
    ("Economic Development", ("jobs", "employment", "hire", "workers", "economic", "economy", "workforce")),
    ("Infrastructure / Traffic", ("traffic", "construction", "road", "truck", "congestion", "infrastructure")),
]

# Topic labels that speak of resistance.
RESISTANCE_LABELS = [
    "Noise / Quality of Life",
    "Water Consumption",
    "Power Grid Strain",
    "Property Values / Land Use",
    "Tax Incentive Fairness",
    "Environmental Impact",
    "Infrastructure / Traffic",
]

# State code, mean temperature (F) and cooling degree days per year.
STATE_CLIMATE = [
    ("51", 55.1, 1100.0),
    ("48", 64.8, 2700.0),
    ("41", 48.4, 300.0),
    ("19", 47.0, 700.0),
    ("04", 60.3, 3400.0),
    ("37", 59.0, 1500.0),
    ("13", 63.5, 1800.0),
    ("39", 50.7, 700.0),
    ("18", 51.7, 800.0),
    ("53", 48.3, 200.0),
    ("17", 51.8, 800.0),
    ("32", 49.9, 2500.0),
    ("45", 62.4, 1700.0),
    ("47", 57.6, 1300.0),
    ("49", 48.6, 700.0),
]

# Fuel codes counted as renewable, and the code of the all-fuel total.
RENEWABLE_FUELS = ["SUN", "WND", "HYC", "GEO", "WWW"]
TOTAL_FUEL = "ALL"

# Features of each dimension, and those where a higher value is worse.
DIMENSIONS = {
    "power": [
        "industrial_rate_cents_kwh",
        "renewable_pct",
        "total_generation_mwh",
        "renewable_potential_score",
    ],
    "environmental": [
        "avg_temp_f",
        "cooling_degree_days",
        "solar_ghi_kwh_m2_day",
        "groundwater_level_ft",
        "surface_water_flow_cfs",
        "drought_severity_index",
    ],
    "social": [
        "social_resistance_score",
        "posts_per_capita",
    ],
}
INVERTED_FEATURES = [
    "industrial_rate_cents_kwh",
    "avg_temp_f",
    "cooling_degree_days",
    "drought_severity_index",
    "social_resistance_score",
    "posts_per_capita",
]

# Features to keep when two say nearly the same.
PRIORITY_FEATURES = [
    "industrial_rate_cents_kwh",
    "renewable_pct",
    "solar_ghi_kwh_m2_day",
    "social_resistance_score",
    "avg_temp_f",
    "cooling_degree_days",
]

# Columns that identify a row and are never normalized.
ID_COLUMNS = [
    "county_fips", "state_fips", "state", "county_name",
    "lat", "lon", "model_version", "weights_used",
]

# Weights used when none could be learned, and the scenarios tried against them.
FALLBACK_WEIGHTS = {"power": 0.45, "environmental": 0.30, "social": 0.25}
WEIGHT_SCENARIOS = {
    "Power-heavy": {"power": 0.60, "environmental": 0.25, "social": 0.15},
    "Balanced": {"power": 0.33, "environmental": 0.34, "social": 0.33},
    "Social-heavy": {"power": 0.30, "environmental": 0.25, "social": 0.45},
    "Env-heavy": {"power": 0.25, "environmental": 0.50, "social": 0.25},
}
MODEL_VERSION = "1.0.0"

# Columns a score list may be sorted by.
SORTABLE_SCORES = [
    "psi", "power_score", "environmental_score", "social_score", "confidence", "rank",
]

# Sites that were stopped (name, county, state, year proposed, outcome, reason).
BLOCKED_SITES = [
    ("QTS Mt. Prospect", "17031", "IL", 2022, "blocked", "zoning_denial"),
    ("Prince William County DC Moratorium", "51153", "VA", 2023, "moratorium", "community_opposition"),
    ("Haymarket Data Center (PW Digital Gateway)", "51153", "VA", 2021, "blocked", "community_opposition"),
    ("Compass Datacenters Chandler AZ", "04013", "AZ", 2022, "blocked", "water_concerns"),
    ("Vantage Mesa AZ", "04013", "AZ", 2022, "delayed", "water_concerns"),
    ("Meta Zeewolde Netherlands", None, None, 2022, "cancelled", "community_opposition"),
    ("EdgeCore Sterling VA", "51107", "VA", 2023, "delayed", "grid_capacity"),
    ("CloudHQ Manassas VA", "51153", "VA", 2022, "blocked", "zoning_denial"),
    ("Elk Grove Village IL Proposal", "17031", "IL", 2021, "blocked", "noise_concerns"),
    ("Goodyear AZ Water Restriction", "04013", "AZ", 2023, "moratorium", "water_concerns"),
    ("South Holland IL", "17031", "IL", 2023, "blocked", "community_opposition"),
    ("Gainesville VA Proposal", "51153", "VA", 2022, "blocked", "community_opposition"),
    ("Warrenton VA Fauquier County", "51061", "VA", 2023, "moratorium", "community_opposition"),
    ("Culpeper County VA", "51047", "VA", 2023, "moratorium", "community_opposition"),
    ("The Dalles OR Water Limits", "41065", "OR", 2022, "restricted", "water_concerns"),
]

# Sites that were built (name, county, state, year built, outcome).
BUILT_SITES = [
    ("Microsoft Quincy WA", "53025", "WA", 2007, "operational"),
    ("Google The Dalles OR", "41065", "OR", 2006, "operational"),
    ("Google Council Bluffs IA", "19155", "IA", 2009, "operational"),
    ("Facebook Prineville OR", "41013", "OR", 2011, "operational"),
    ("Amazon US-East-1 (Ashburn VA)", "51107", "VA", 2006, "operational"),
    ("Equinix Ashburn VA Campus", "51107", "VA", 2010, "operational"),
    ("Digital Realty Dallas TX", "48113", "TX", 2008, "operational"),
    ("CyrusOne San Antonio TX", "48029", "TX", 2012, "operational"),
    ("QTS Atlanta GA (Suwanee)", "13121", "GA", 2010, "operational"),
    ("Google Lenoir NC", "37027", "NC", 2009, "operational"),
    ("Apple Maiden NC", "37035", "NC", 2010, "operational"),
    ("Facebook New Albany OH", "39049", "OH", 2019, "operational"),
    ("Microsoft Cheyenne WY", "56021", "WY", 2012, "operational"),
    ("Microsoft San Antonio TX", "48029", "TX", 2013, "operational"),
    ("Apple Mesa AZ", "04013", "AZ", 2018, "operational"),
    ("Google Mesa AZ", "04013", "AZ", 2020, "operational"),
    ("Microsoft Des Moines IA", "19153", "IA", 2014, "operational"),
    ("CoreSite Reston VA", "51059", "VA", 2003, "operational"),
    ("Equinix Chicago IL", "17031", "IL", 2002, "operational"),
    ("Digital Realty Phoenix AZ", "04013", "AZ", 2015, "operational"),
    ("Switch Las Vegas NV", "32003", "NV", 2000, "operational"),
    ("T5 DFW Dallas TX", "48113", "TX", 2017, "operational"),
    ("Aligned Salt Lake City UT", "49035", "UT", 2020, "operational"),
    ("NTT Nashville TN", "47037", "TN", 2019, "operational"),
    ("Iron Mountain Manassas VA", "51153", "VA", 2016, "operational"),
]
