"""Tables that labels and questions are built on. Results depend on them letter by letter."""

PAGE_TYPES = {
    "home": "home page of a site",
    "news_article": "news story",
    "blog_post": "blog post",
    "article": "other article, guide or report",
    "docs": "technical documentation or reference",
    "forum_thread": "forum or discussion thread",
    "qa": "question and answers",
    "faq": "frequently asked questions",
    "listing": "list or category of items, posts or results",
    "search_results": "search results",
    "product": "single product for sale",
    "local_business": "local business, place or venue",
    "event": "event",
    "job_post": "job opening",
    "recipe": "recipe",
    "how_to": "step-by-step instructions",
    "profile": "profile of a person or account",
    "about": "about page",
    "contact": "contact page",
    "video": "page built around a video",
    "course": "course or class",
    "software": "software or app",
}
PAGE_STATUS = {
    "ok": "a real page with usable content",
    "not_found": "not found or deleted",
    "login_required": "login or sign-up wall",
    "blocked_or_denied": "access denied or blocked",
    "server_error": "server error",
}
QUESTIONS = {
    "page_type": "What kind of page is this?",
    "page_status": "Is this a real, usable page? If not, what is wrong with it?",
    "language": "What language is this page written in?",
    "published_date": "Which date is when this page was published?",
}

# schema.org types and the page type they speak for; the first that matches counts
SCHEMA_PAGE_TYPES = [
    ("job_post", ["JobPosting"]),
    ("recipe", ["Recipe"]),
    ("event", ["Event", "MusicEvent", "SportsEvent", "TheaterEvent", "BusinessEvent", "EducationEvent", "Festival", "ExhibitionEvent", "SocialEvent"]),
    ("faq", ["FAQPage"]),
    ("qa", ["QAPage"]),
    ("forum_thread", ["DiscussionForumPosting"]),
    ("how_to", ["HowTo"]),
    ("course", ["Course"]),
    ("product", ["Product", "ProductGroup", "IndividualProduct"]),
    ("search_results", ["SearchResultsPage"]),
    ("listing", ["CollectionPage", "ItemList", "OfferCatalog"]),
    ("news_article", ["NewsArticle", "ReportageNewsArticle", "AnalysisNewsArticle", "OpinionNewsArticle"]),
    ("blog_post", ["BlogPosting", "LiveBlogPosting"]),
    ("docs", ["TechArticle", "APIReference"]),
    ("article", ["Article", "ScholarlyArticle", "Report"]),
    ("profile", ["ProfilePage"]),
    ("about", ["AboutPage"]),
    ("contact", ["ContactPage"]),
    ("video", ["VideoObject"]),
    ("software", ["SoftwareApplication", "MobileApplication", "WebApplication"]),
    ("local_business", ["LocalBusiness", "Restaurant", "Hotel", "Store", "Dentist", "MedicalClinic", "AutoRepair", "RealEstateAgent", "LegalService", "BeautySalon", "LodgingBusiness"]),
]
OG_TYPES = {
    "article": ["article", "blog_post", "docs", "how_to", "news_article", "recipe"],
    "product": ["product"],
    "profile": ["profile"],
    "video.movie": ["video"],
    "video.other": ["video"],
    "video.episode": ["video"],
}
URL_HINTS = [
    ("search_results", r"/search\b|[?&](q|s|query)="),
    ("listing", r"/(tag|tags|category|categories)/"),
    ("contact", r"/contact"),
    ("about", r"/about"),
    ("job_post", r"/jobs?/|/careers?/"),
    ("forum_thread", r"/forum|/threads?/|/topic/"),
    ("docs", r"/docs?/|/documentation/"),
]
URL_CONFLICTS = {
    "listing": ["product", "recipe", "event", "job_post", "news_article", "blog_post", "article"],
    "search_results": ["product", "recipe", "event", "job_post", "news_article", "blog_post", "article"],
}
HOME_COMPATIBLE = ["listing", "local_business", "software", "about"]
HTTP_STATUS = {
    404: "not_found",
    410: "not_found",
    401: "login_required",
    403: "blocked_or_denied",
    451: "blocked_or_denied",
    500: "server_error",
    502: "server_error",
    503: "server_error",
}
# detector code, page code, name
LANGUAGES = [
    ("eng", "en", "English"), ("deu", "de", "German"), ("fra", "fr", "French"), ("spa", "es", "Spanish"), ("ita", "it", "Italian"),
    ("por", "pt", "Portuguese"), ("nld", "nl", "Dutch"), ("rus", "ru", "Russian"), ("pol", "pl", "Polish"), ("jpn", "ja", "Japanese"),
    ("zho", "zh", "Chinese"), ("kor", "ko", "Korean"), ("ara", "ar", "Arabic"), ("tur", "tr", "Turkish"), ("ukr", "uk", "Ukrainian"),
    ("ces", "cs", "Czech"), ("swe", "sv", "Swedish"), ("dan", "da", "Danish"), ("nor", "no", "Norwegian"), ("fin", "fi", "Finnish"),
    ("hun", "hu", "Hungarian"), ("ron", "ro", "Romanian"), ("ell", "el", "Greek"), ("heb", "he", "Hebrew"), ("hin", "hi", "Hindi"),
    ("ind", "id", "Indonesian"), ("vie", "vi", "Vietnamese"), ("tha", "th", "Thai"), ("fas", "fa", "Persian"), ("bul", "bg", "Bulgarian"),
    ("slk", "sk", "Slovak"), ("hrv", "hr", "Croatian"), ("srp", "sr", "Serbian"), ("lit", "lt", "Lithuanian"), ("lav", "lv", "Latvian"),
    ("est", "et", "Estonian"), ("slv", "sl", "Slovenian"), ("cat", "ca", "Catalan"), ("msa", "ms", "Malay"), ("ben", "bn", "Bengali"),
]
ISO3 = {a: b for a, b, _ in LANGUAGES}
LANGUAGE_NAMES = {b: c for _, b, c in LANGUAGES}

MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
MONTH_NUMBERS = {m: i for i, m in enumerate(MONTHS, 1)} | {m[:3]: i for i, m in enumerate(MONTHS, 1)}
# pattern and the group numbers of (year, month, day) readings
DATE_PATTERNS = [
    (r"\b((?:19|20)\d\d)-(\d{1,2})-(\d{1,2})\b", [(1, 2, 3)]),
    (r"\b(\d{1,2})[./](\d{1,2})[./]((?:19|20)\d\d)\b", [(3, 2, 1), (3, 1, 2)]),
    (r"\b(\d{1,2})(?:st|nd|rd|th)?\s+([A-Za-z]{3,9})\.?,?\s+((?:19|20)\d\d)\b", [(3, 2, 1)]),
    (r"\b([A-Za-z]{3,9})\.?\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+((?:19|20)\d\d)\b", [(3, 1, 2)]),
    (r"((?:19|20)\d\d)\s*年\s*(\d{1,2})\s*月\s*(\d{1,2})\s*日", [(1, 2, 3)]),
]

# the older set of decisions
V0_PAGE_TYPES = {
    "product": "A single product page that sells one item",
    "listing": "A listing, category or search results page showing many items",
    "article": "An article, blog post or news story",
    "other": "Another kind of page, such as a home, about, contact, event or recipe page",
}
V0_QUESTIONS = {
    "page_type": "What kind of web page is this?",
    "price_field": "Which text shows this product's current selling price?",
    "in_stock": "The product on this page is in stock and can be bought now.",
}
V0_STOCK = {"false": "The product is out of stock or unavailable.", "true": "The product is in stock and can be bought now."}
V0_LISTING = ["ItemList", "CollectionPage", "SearchResultsPage", "OfferCatalog"]
V0_ARTICLE = ["Article", "NewsArticle", "BlogPosting", "Report", "TechArticle", "ScholarlyArticle", "LiveBlogPosting", "OpinionNewsArticle", "AnalysisNewsArticle"]
IN_STOCK = ["InStock", "LimitedAvailability", "OnlineOnly", "InStoreOnly"]
OUT_OF_STOCK = ["OutOfStock", "SoldOut", "Discontinued"]
CURRENCY = r"(?:₹|Rs\.?|INR|\$|US\$|USD|€|EUR|£|GBP|¥|JPY|CNY|A\$|AUD|C\$|CAD|CHF|kr|SEK|NOK|DKK|zł|PLN|R\$|BRL|₩|KRW|₺|TRY|₽|RUB)"
NUMBER = r"\d+(?:[.,]\d{2,3}|[  ]\d{3})*"

SPLIT_SHARES = [("train", 0.80), ("development", 0.08), ("calibration", 0.06), ("test", 0.06)]
NOUL_PREFIX = "True or false: "
SCORE_PREFIX = "Pick the level that fits best: "
NOUL_DEFAULT = {"false": "The statement is false.", "true": "The statement is true."}
