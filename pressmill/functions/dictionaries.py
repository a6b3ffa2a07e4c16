"""The dictionaries the rules read. All are defaults that callers may replace."""

# Places that say nothing about where somebody is.
GENERIC_LOCATIONS = [
    "unknown", "wherever you are", "earth", "mars", "world", "global", "worldwide", "everywhere", "somewhere", "nowhere",
    "africa", "europe", "asia", "america", "united states", "united kingdom", "canada", "australia", "planet earth",
    "the world", "around the world", "anywhere", "hidden", "secret", "private", "n/a", "na", "none",
]

# Terms of each country for the location classifier.
LOCATION_RULES = {
    "Nigeria": {
        "keywords": ["nigeria", "nigerian", "naija", "lagos", "abuja", "kano", "ibadan", "port harcourt", "tinubu", "buhari", "apc", "pdp", "nigerian government"],
        "sources": ["punch", "guardian nigeria", "vanguard", "thisday", "daily trust", "leadership", "tribune", "premium times", "sahara reporters"],
        "domains": ["punchng.com", "guardian.ng", "vanguardngr.com", "thisdaylive.com"],
    },
    "US": {
        "keywords": ["america", "american", "washington", "new york", "california", "texas", "usa", "united states", "white house", "congress", "nfl", "nba"],
        "sources": ["cnn", "fox news", "nbc", "abc", "cbs", "usa today", "new york times", "washington post", "wall street journal"],
        "domains": ["cnn.com", "foxnews.com", "nbcnews.com", "usatoday.com", "nytimes.com"],
    },
    "UK": {
        "keywords": ["britain", "british", "london", "manchester", "liverpool", "uk", "united kingdom", "england", "scotland", "wales", "bbc", "nhs", "parliament"],
        "sources": ["bbc", "guardian", "telegraph", "independent", "daily mail", "mirror"],
        "domains": ["bbc.co.uk", "theguardian.com", "telegraph.co.uk", "dailymail.co.uk"],
    },
    "Qatar": {
        "keywords": ["qatar", "doha", "qatari", "al thani", "emir", "lusail", "al wakrah", "gulf", "middle east", "arabian"],
        "sources": ["al jazeera", "gulf times", "peninsula", "qatar tribune"],
        "domains": ["aljazeera.com", "gulf-times.com", "thepeninsulaqatar.com"],
    },
    "India": {
        "keywords": ["india", "indian", "bharat", "hindustan", "mumbai", "delhi", "bangalore", "hyderabad", "chennai", "kolkata", "bollywood", "cricket", "modi"],
        "sources": ["times of india", "the hindu", "hindustan times", "indian express", "ndtv"],
        "domains": ["timesofindia.indiatimes.com", "thehindu.com", "hindustantimes.com"],
    },
}

# Country by place name and by user name, first match wins.
COUNTRY_BY_LOCATION = {
    "qatar": ["qatar", "doha"],
    "nigeria": ["nigeria", "lagos", "abuja", "kano"],
    "india": ["india", "mumbai", "delhi", "bangalore"],
    "us": ["usa", "united states", "new york", "california"],
    "uk": ["uk", "united kingdom", "london", "england"],
    "uae": ["uae", "dubai", "abu dhabi"],
}
COUNTRY_BY_USERNAME = {
    "qatar": ["qatar", "doha", "qa_"],
    "nigeria": ["nigeria", "ng_", "lagos", "abuja"],
    "india": ["india", "in_", "mumbai", "delhi"],
}

# Ministries by keyword, most hits win.
MINISTRY_KEYWORDS = {
    "budget_economic_planning": ["economy", "budget", "economic", "fiscal", "monetary", "inflation"],
    "works": ["infrastructure", "road", "bridge", "construction", "development", "project"],
    "education": ["education", "school", "university", "student", "teacher", "learning"],
    "health_social_welfare": ["health", "hospital", "medical", "healthcare", "doctor", "medicine"],
    "interior": ["security", "police", "crime", "safety", "law enforcement", "terrorism"],
    "agriculture_food_security": ["agriculture", "farming", "food", "crop", "farm", "agricultural"],
    "power": ["energy", "power", "electricity", "renewable"],
    "petroleum_resources": ["oil", "gas", "petroleum", "fuel"],
    "transportation": ["transport", "transportation", "traffic", "vehicle", "mobility"],
    "housing_urban": ["housing", "house", "home", "residential", "urban development"],
    "environment_ecological": ["environment", "climate", "pollution", "conservation", "green"],
    "finance": ["finance", "banking", "financial", "bank"],
    "foreign_affairs": ["foreign", "diplomacy", "international", "embassy"],
    "justice": ["justice", "court", "legal", "judiciary", "corruption"],
    "defence": ["defense", "military", "armed forces", "war"],
    "labour_employment": ["employment", "job", "work", "labour", "unemployment"],
    "water_resources": ["water", "sanitation", "irrigation"],
    "women_affairs": ["women", "gender", "female", "equality"],
    "youth_development": ["youth", "young", "teenager", "adolescent"],
    "science_technology": ["technology", "science", "innovation", "digital"],
    "communications_digital": ["communication", "telecom", "digital", "cyber"],
}

# Priority topics with their keywords.
TOPIC_KEYWORDS = {
    "fuel_subsidy": ["fuel", "subsidy", "petrol", "diesel", "energy", "pump", "price"],
    "security": ["security", "terrorism", "banditry", "kidnapping", "police", "military", "defense"],
    "youth_employment": ["youth", "employment", "jobs", "unemployment", "skills", "training"],
    "foreign_relations": ["diplomacy", "foreign", "international", "trade", "partnership"],
    "infrastructure": ["roads", "bridges", "railways", "airports", "infrastructure", "development"],
    "economy": ["economy", "gdp", "inflation", "growth", "investment", "business"],
    "corruption": ["corruption", "transparency", "accountability", "anti-corruption"],
    "healthcare": ["health", "hospital", "medical", "vaccine", "disease", "healthcare"],
    "education": ["education", "school", "university", "students", "teachers", "learning"],
}
# The ministry of a topic, and ministries by keyword where there is no topic.
TOPIC_MINISTRY = {
    "fuel_subsidy": "energy", "security": "defense", "youth_employment": "labor", "foreign_relations": "foreign", "infrastructure": "transport",
    "economy": "finance", "corruption": "justice", "healthcare": "health", "education": "education",
}
INFERRED_MINISTRY = {
    "health": ["health", "hospital", "medical", "doctor", "patient", "vaccine", "disease"],
    "education": ["education", "school", "university", "student", "teacher", "learning"],
    "finance": ["economy", "budget", "money", "financial", "bank", "investment", "tax"],
    "defense": ["security", "military", "police", "terrorism", "banditry", "kidnapping"],
    "transport": ["road", "bridge", "railway", "airport", "transport", "infrastructure"],
    "energy": ["fuel", "electricity", "power", "energy", "petrol", "diesel", "gas"],
    "agriculture": ["farm", "crop", "agriculture", "food", "farmer", "rural"],
    "justice": ["court", "law", "justice", "corruption", "crime", "legal"],
    "foreign": ["diplomacy", "foreign", "international", "embassy", "trade"],
    "labor": ["employment", "job", "worker", "labor", "unemployment", "youth"],
}
# Words that count as keywords wherever they stand.
CIVIC_WORDS = ["president", "government", "policy", "ministry", "budget", "reform", "development", "program", "initiative", "project", "funding", "citizens", "public", "community", "nation", "country"]

# Platforms.
SOCIAL = ["x", "twitter", "facebook", "instagram", "tiktok"]

# Feed regions by part of a URL, first match wins.
FEED_REGIONS = {
    "Nigeria": [
        "nigeria", "ng", "tribuneonlineng", "vanguardngr", "thisdaylive", "businessday.ng", "thenationonlineng", "herald.ng", "dailypost.ng", "guardian.ng",
        "punchng", "premiumtimesng", "informationng", "ripplesnigeria", "dailynigerian", "thenews-chronicle", "pointblanknews", "hallmarknews",
        "pmnewsnigeria", "saharareporters", "lindaikejisblog", "bellanaija",
    ],
    "Qatar": ["qatar", "qa", "qna.org.qa", "alwatannews", "aljazeera", "dohanews", "gulf-times"],
    "India": ["india", "indianexpress", "nationalheraldindia", "economictimes.indiatimes", "thehindu", "hindustantimes", "tribuneindia"],
    "UK": ["uk", "telegraph.co.uk", "mirror.co.uk", "hulldailymail.co.uk", "feedburner.com"],
}

# What votes for a country. names, cities: parts of a user's place; codes: whole words of a name, and its
# endings after _; handles: parts of a name; people: its word for a compatriot; social, news: terms of texts; outlets: parts
# of a platform; domains: parts of a news place; spelling: spellings in texts.
COUNTRY_VOTES = {
    "US": {
        "names": ["usa", "united states", "america", "us ", "u.s", "u.s.a"],
        "cities": ["new york", "california", "texas", "florida", "chicago", "los angeles", "boston", "washington", "seattle", "atlanta"],
        "codes": ["us", "usa", "america"],
        "endings": ["us", "usa"],
        "handles": ["nyc", "newyork", "chicago", "la", "losangeles", "boston", "texas", "florida", "cali", "california"],
        "people": "american",
        "social": ["america", "american", "washington", "new york", "california", "texas", "usa", "united states", "white house", "congress", "nfl", "nba"],
        "news": ["america", "american", "washington", "new york", "california", "texas", "usa", "united states", "white house", "congress"],
        "outlets": ["cnn", "fox", "nbc", "abc", "cbs", "usa today", "new york times", "washington post", "huffpost", "newsweek", "politico", "bloomberg", "cnbc"],
        "domains": ["cnn", "foxnews", "nbc", "abc", "cbs", "usatoday", "nytimes", "washingtonpost", "wsj", "latimes"],
        "spelling": ["color", "center", "favorite", "analyze", "organize", "defense", "license", "traveling"],
    },
    "UK": {
        "names": ["uk", "united kingdom", "england", "scotland", "wales", "britain", "great britain"],
        "cities": ["london", "manchester", "liverpool", "birmingham", "leeds", "glasgow", "edinburgh", "bristol", "cardiff", "belfast"],
        "codes": ["uk", "gb", "britain"],
        "endings": ["uk", "gb"],
        "handles": ["london", "manchester", "liverpool", "birmingham", "leeds", "glasgow", "edinburgh"],
        "people": "british",
        "social": ["britain", "british", "london", "manchester", "liverpool", "uk", "united kingdom", "england", "scotland", "wales", "bbc", "nhs", "parliament"],
        "news": ["britain", "british", "london", "manchester", "liverpool", "uk", "united kingdom", "england", "scotland", "wales", "parliament"],
        "outlets": ["bbc", "guardian", "telegraph", "independent", "daily mail", "mirror", "sun", "times", "economist", "financial times", "sky news"],
        "domains": ["bbc", "guardian", "telegraph", "independent", "dailymail", "ft.com", "economist", "reuters"],
        "spelling": ["colour", "centre", "favourite", "analyse", "organise", "defence", "licence", "travelling"],
    },
    "Qatar": {
        "names": ["qatar", "doha"],
        "cities": ["doha", "al wakrah", "al rayyan", "lusail", "al khor", "dukhan", "mesaieed", "al shamal"],
        "codes": ["qa", "qatar"],
        "endings": ["qa", "qatar"],
        "handles": ["doha", "alwakrah", "rayyan", "lusail"],
        "people": "qatari",
        "social": ["qatar", "doha", "qatari", "al thani", "emir", "gulf", "middle east", "arabian", "sharia", "islamic"],
        "news": [
            "qatar", "doha", "qatari", "al thani", "emir", "gulf", "middle east", "arabian", "lusail", "al wakrah", "al khor", "education city",
            "katara", "the pearl", "west bay", "aspire", "hamad", "khalifa", "corniche", "souq waqif", "msheireb", "al sadd",
        ],
        "outlets": [
            "al jazeera", "gulf times", "peninsula", "qatar tribune", "diwan.gov.qa", "gco.gov.qa", "qatar news agency", "qatar day", "doha news",
            "lusail news", "al-sharq", "raya", "al-watan", "qatar living", "iloveqatar", "marhaba", "qatar observer", "qatar gazette",
            "qatar chronicle", "qna", "thepeninsulaqatar",
        ],
        "domains": [
            "aljazeera", "gulf-times", "thepeninsulaqatar", "qatar", "qna.org.qa", "dohanews", "qatarliving", "iloveqatar", "marhaba.qa", "qatarday",
            "lusailnews", "alarab.qa", "al-sharq", "raya", "al-watan", "qatargazette", "qatarchronicle", "qatarobserver",
        ],
        "spelling": ["al-", "bin ", "ibn ", "abdul", "sheikh", "sharia", "majlis", "emir"],
    },
    "UAE": {
        "names": ["uae", "united arab emirates", "dubai", "abu dhabi", "sharjah"],
        "cities": ["dubai", "abu dhabi", "sharjah", "ajman", "ras al khaimah", "fujairah", "umm al quwain", "al ain"],
        "codes": ["ae", "uae"],
        "endings": ["ae", "uae"],
        "handles": ["dubai", "abu dhabi", "sharjah", "ajman", "ras al khaimah", "fujairah", "umm al quwain", "al ain"],
        "people": "uae",
        "social": ["uae", "dubai", "abu dhabi", "sharjah", "ajman", "ras al khaimah", "fujairah", "umm al quwain", "al ain"],
        "news": [], "outlets": [], "domains": [], "spelling": [],
    },
    "India": {
        "names": ["india", "bharat", "hindustan"],
        "cities": [
            "mumbai", "delhi", "bangalore", "hyderabad", "chennai", "kolkata", "pune", "ahmedabad", "jaipur", "surat", "lucknow", "kanpur", "nagpur",
            "indore", "thane", "bhopal", "visakhapatnam", "patna", "vadodara", "ghaziabad", "ludhiana", "agra", "nashik", "faridabad", "meerut",
            "rajkot", "kalyan-dombivli", "vasai-virar", "varanasi", "srinagar", "aurangabad", "dhanbad", "amritsar", "navi mumbai", "allahabad",
            "ranchi", "howrah", "coimbatore", "jabalpur", "gwalior", "vijayawada", "jodhpur", "madurai", "raipur", "kota", "guwahati", "chandigarh",
        ],
        "codes": ["in", "india", "bharat"],
        "endings": ["in", "india"],
        "handles": ["mumbai", "delhi", "bangalore", "bengaluru", "chennai", "kolkata", "hyderabad", "pune", "ahmedabad", "jaipur"],
        "people": "indian",
        "social": ["india", "indian", "bharat", "hindustan", "mumbai", "delhi", "bangalore", "hyderabad", "chennai", "kolkata", "bollywood", "cricket", "modi", "rupee", "hindi", "tamil", "telugu", "bengali"],
        "news": [
            "india", "indian", "bharat", "hindustan", "mumbai", "delhi", "bangalore", "hyderabad", "chennai", "kolkata", "bollywood", "cricket",
            "modi", "rupee", "hindi", "tamil", "telugu", "bengali", "parliament", "lok sabha", "rajya sabha", "supreme court",
        ],
        "outlets": [
            "times of india", "the hindu", "hindustan times", "indian express", "ndtv", "india today", "republic world", "zee news", "news18", "firstpost",
            "the wire", "scroll.in", "the quint", "business standard", "economic times", "livemint", "moneycontrol", "ani", "pti",
        ],
        "domains": [
            "timesofindia", "thehindu", "hindustantimes", "indianexpress", "ndtv", "indiatoday", "republicworld", "zeenews", "news18", "firstpost",
            "thewire", "scroll", "thequint", "business-standard", "economictimes", "livemint", "moneycontrol", "aninews", "ptinews",
        ],
        "spelling": [],
    },
}
# Platforms of news, endings that make a news place a domain, and parts of Arabic names.
NEWS_PLATFORMS = ["cnn", "bbc", "fox", "nbc", "abc", "cbs", "newsweek", "huffpost", "pbs"]
NEWS_ENDINGS = [".com", ".org", ".net", ".qa", ".in", ".co.in"]
ARABIC_NAMES = ["al-", "bin-", "ibn-", "abdul", "sheikh"]

# The category of a free suggestion by the first term in it, in this order.
CATEGORY_TERMS = [
    ("education", ["education", "educational", "school", "university", "student", "teacher", "learning"]),
    ("health_social_welfare", ["health", "healthcare", "medical", "hospital", "doctor", "medicine", "disease"]),
    ("works", ["infrastructure", "road", "bridge", "construction", "project", "infrastructure development"]),
    ("budget_economic_planning", ["economy", "economic"]),
    ("finance", ["finance"]),
    ("budget_economic_planning", ["budget"]),
    ("finance", ["financial", "money"]),
    ("budget_economic_planning", ["inflation", "recession", "growth"]),
    ("interior", ["security", "crime", "terrorism", "violence"]),
    ("police_affairs", ["police", "law enforcement"]),
    ("justice", ["corruption", "corrupt", "fraud", "bribery", "embezzlement"]),
    ("agriculture_food_security", ["agriculture", "agricultural", "farming", "food", "crop"]),
    ("livestock_development", ["livestock"]),
    ("power", ["energy", "power", "electricity"]),
    ("petroleum_resources", ["oil", "gas", "petroleum"]),
    ("transportation", ["transport", "transportation", "traffic", "vehicle"]),
    ("aviation_aerospace", ["aviation", "airline", "airport"]),
    ("housing_urban", ["housing", "house", "home"]),
    ("environment_ecological", ["environment", "environmental", "climate", "pollution"]),
    ("foreign_affairs", ["foreign", "diplomacy", "international"]),
    ("defence", ["defense", "defence", "military", "armed forces"]),
    ("justice", ["justice", "court", "legal", "judiciary"]),
    ("health_social_welfare", ["welfare"]),
    ("humanitarian_poverty", ["poverty", "humanitarian"]),
    ("youth_development", ["youth", "young"]),
    ("labour_employment", ["unemployment", "employment", "job", "work"]),
    ("science_technology", ["technology", "tech"]),
    ("communications_digital", ["digital"]),
    ("science_technology", ["innovation"]),
    ("communications_digital", ["cyber"]),
    ("special_duties", ["election", "voting", "democracy", "electoral"]),
    ("information_culture", ["media", "press", "journalism", "information"]),
    ("industry_trade", ["trade", "commerce", "business", "investment"]),
    ("women_affairs", ["gender", "women", "female", "women affairs", "women affairs and social development"]),
    ("interior", ["religion", "religious", "faith"]),
    ("finance", ["banking", "bank", "financial sector"]),
    ("special_duties", ["administration", "administrative", "government", "governance", "bureaucracy"]),
    ("justice", ["transparency", "accountability", "open government"]),
    ("humanitarian_poverty", ["crisis", "emergency", "disaster"]),
    ("niger_delta", ["regional", "regional development", "niger delta"]),
    ("water_resources", ["water", "sanitation", "irrigation"]),
    ("tourism", ["tourism", "tourist", "hospitality"]),
    ("sports_development", ["sports", "athlete", "sport"]),
    ("marine_blue_economy", ["marine", "maritime", "ocean", "coastal"]),
    ("solid_minerals", ["minerals", "mining", "mineral"]),
    ("steel_development", ["steel", "industrialization"]),
    ("fct_administration", ["fct", "abuja", "capital"]),
    ("art_culture_creative", ["art", "culture", "creative", "heritage"]),
    ("interior", ["interior", "internal"]),
    ("special_duties", ["presidency", "president", "executive"]),
]
# Suggestions that name no category.
NO_CATEGORY = ["non_governance", "unknown", "irrelevant"]

# Issues by the keywords of their titles.
ISSUE_KEYWORDS = {
    "fuel-subsidy-removal": ["subsidy", "removal", "fuel", "petrol", "eliminate"],
    "fuel-price-increase": ["fuel", "price", "increase", "hike", "cost", "expensive"],
    "fuel-scarcity": ["scarcity", "shortage", "queue", "unavailable", "fuel"],
    "oil-theft": ["theft", "pipeline", "vandalism", "steal", "oil"],
    "nnpc-reforms": ["nnpc", "reform", "restructure", "transformation"],
    "banditry-attacks": ["bandit", "attack", "raid", "armed", "bandits", "zamfara", "katsina", "kaduna"],
    "kidnapping": ["kidnap", "abduct", "hostage", "ransom"],
    "insurgency": ["boko haram", "insurgency", "terrorism", "iswap"],
    "herder-farmer-conflict": ["herder", "farmer", "clash", "cattle", "conflict"],
    "police-brutality": ["police", "brutality", "sars", "abuse", "excessive force"],
    "asuu-strike": ["asuu", "strike", "lecturers", "academic"],
    "school-infrastructure": ["school", "infrastructure", "building", "facility"],
    "education-funding": ["education", "budget", "funding", "allocation"],
    "student-loan": ["student", "loan", "scheme", "nelfund"],
    "healthcare-crisis": ["healthcare", "hospital", "medical", "crisis"],
    "drug-shortage": ["drug", "shortage", "medicine", "unavailable"],
    "doctor-strike": ["doctor", "strike", "medical", "personnel"],
    "budget-implementation": ["budget", "implementation", "execution", "2024", "2025"],
    "budget-increase": ["budget", "increase", "raise", "higher"],
    "fiscal-policy": ["fiscal", "policy", "monetary", "economic"],
    "debt-management": ["debt", "loan", "borrowing", "repayment"],
    "diplomatic-visit": ["visit", "bilateral", "diplomatic", "delegation"],
    "visa-policy": ["visa", "entry", "immigration", "permit"],
    "international-cooperation": ["cooperation", "partnership", "agreement", "treaty"],
    "road-construction": ["road", "construction", "highway", "infrastructure"],
    "project-commissioning": ["commission", "project", "inauguration", "launch"],
    "corruption-scandal": ["corruption", "scandal", "fraud", "embezzle"],
    "judicial-reform": ["judicial", "reform", "court", "justice"],
    "food-security": ["food", "security", "agriculture", "farming"],
    "farmer-support": ["farmer", "support", "subsidy", "input"],
    "railway-development": ["railway", "train", "rail", "track"],
    "airport-upgrade": ["airport", "aviation", "upgrade", "terminal"],
    "government-policy": ["policy", "government", "administration"],
    "political-statement": ["statement", "comment", "remark", "political"],
}
# Words that don't enter the slug of a title.
TITLE_STOP_WORDS = ["the", "a", "an", "in", "on", "at", "for", "to", "of", "and", "or"]

# Terms of news, of what isn't, and of news addresses.
NEWS_TERMS = [
    "news", "politics", "government", "policy", "economy", "business", "national", "public", "official", "announcement", "statement", "press",
    "briefing", "minister", "president", "governor", "senate", "house", "assembly", "election", "vote", "campaign", "budget", "revenue", "tax",
    "infrastructure", "development", "security", "military", "police", "court", "judge", "law", "bill", "act", "regulation", "commission", "agency",
    "department", "ministry", "tinubu", "shettima", "apc", "pdp", "labour", "protest", "workers", "minimum wage", "cost of living", "lagos", "abuja",
    "nigeria", "update", "latest", "breaking", "report", "story", "article", "post",
]
SKIP_TERMS = [
    "masturbate", "sex", "drunk", "alcohol", "piss", "bed", "belle", "husband", "wife", "girlfriend", "sister", "divorce", "marriage", "dating", "love",
    "romance", "kiss", "kissing", "wakeup", "show", "backyard", "marketrunz", "kulele", "nightjolly", "hottori", "stories", "exclusive-interviews",
    "editorial", "burna", "tiwa", "savage", "bayanni", "davido", "ayra", "starr", "2baba", "billboard", "mobo", "awards", "album", "song", "concert",
    "artist", "super eagles", "football", "basketball", "boxing", "athlete", "player", "team", "match", "game", "sport", "fitness", "health", "medical",
    "hiv", "zobo", "blood", "kidnap", "pikin", "shop", "sell",
]
NEWS_ADDRESSES = ["news", "article", "story", "post", "update", "latest"]

# Phrases of factual, strongly negative and undecided texts.
FACTUAL_PHRASES = ["meeting with", "discussed with", "spoke with", "visited", "attended", "participated in"]
NEGATIVE_WORDS = ["terrible", "awful", "hate", "horrible"]
UNDECIDED_PHRASES = ["don't particularly like", "not great but not bad", "don't hate it either", "i don't particularly like it, but i don't hate it either"]
