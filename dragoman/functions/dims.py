"""Small static dimensions. Everything in this file is a fixed value that results depend on."""

from __future__ import annotations

# Size and score settings.
MIN_CHUNK, TARGET_CHUNK, MAX_CHUNK = 80, 700, 1200
CHAR_OVERLAP = 120
SHORT_DOC = 500
STRICT_MIN_CHARS, STRICT_MIN_ALPHA = 100, 0.40
LENIENT_MIN_CHARS, LENIENT_SHORT_MIN_CHARS, LENIENT_MIN_ALPHA = 40, 20, 0.25
MIN_YIELD = 0.05
REVERSED_RATIO = 0.30
MAX_MESSAGE = 1000
LOW_CONFIDENCE = 0.55
INTENT_THRESHOLD = 0.3
BM25_K1, BM25_B = 1.2, 0.75
ALPHA = 0.6
POOL_SIZE = 25
RERANK_THRESHOLD = 0.25
FRESH_DAYS = 365
STALE_FACTOR = 0.25
PRIORITY_BOOST = {"high": 1.30, "normal": 1.00, "low": 0.60}
CONTEXT_CHARS, CONTEXT_CHUNKS, CONTEXT_TAIL = 4000, 8, 200
RATE_LIMIT, RATE_WINDOW = 30, 60
SESSION_MINUTES = 30
MAX_TURNS, MAX_TOKENS = 6, 2000

# Category tiers.
HIGH_CATEGORIES = [
    "academics", "admissions", "about", "administration", "contact", "student_life",
    "documents", "it_services",
]
LOW_CATEGORIES = ["news_events", "community", "jobs"]
EXCLUDED_CATEGORIES = ["news_events", "jobs", "community"]

# Ordered category rules, first match wins. Site-specific host words are passed by the
# caller as rules of its own.
CATEGORY_RULES = [
    ("admissions", ["admis", "registr", "apply", "tuition", "fees", "scholarship", "financial"]),
    ("academics", ["college", "faculty", "depart", "program", "course", "curriculum", "syllabus", "degree", "catalog"]),
    ("research", ["research", "publication", "journal", "thesis", "dissertation", "graduate"]),
    ("student_life", ["student", "club", "activit", "housing", "counseling", "career", "alumni"]),
    ("administration", ["admin", "president", "board", "council", "senate", "procurement", "human-resources", "financial"]),
    ("library", ["library"]),
    ("jobs", ["jobs", "careers", "vacancies"]),
    ("about", ["about", "history", "vision", "mission", "structure"]),
    ("documents", ["handbook", "guide", "regulation", "bylaw", "policy"]),
]
RELABEL_RULES = [
    ("academics", ["college", "faculty", "depart", "program", "course", "curriculum", "catalog"]),
    ("admissions", ["admis", "registr", "tuition", "fees", "scholarship"]),
    ("research", ["research", "thesis", "publication", "journal"]),
    ("student_life", ["student", "housing", "club", "scholarship"]),
    ("administration", ["admin", "president", "council", "senate"]),
    ("library", ["library"]),
    ("about", ["about", "history", "vision", "mission"]),
]

# Intent labels.
INTENTS = [
    "faq_fees", "faq_registration", "faq_admission", "faq_graduation", "faq_scholarships", "schedule_exams",
    "schedule_classes", "schedule_academic_calendar", "staff_info", "department_info", "course_info",
    "library_info", "campus_services", "student_id_query", "greeting", "goodbye", "thanks", "unknown",
]
CANNED_INTENTS = ["greeting", "goodbye", "thanks", "capabilities"]
CAPABILITY_INTENTS = ["what_can_you_do", "help", "capabilities", "features"]
# Number of canned replies per pool, Arabic and English alike
# (the capabilities pool has one entry per line of its text).
REPLY_POOL_SIZES = {
    "greeting": 3, "return_greeting": 2, "thanks": 3, "goodbye": 3, "after_help_goodbye": 2,
    "low_confidence": 3, "escalation": 3, "fallback": 2, "capabilities_lines": 7,
}

# Patterns that mark a question about the present.
CURRENT_STATE_EN = [
    "who is", "who are", "current", "present", "president", "dean", "head of", "director",
    "chair", "chancellor", "provost", "registrar", "now", "today", "currently",
]
CURRENT_STATE_AR = [
    "من هو", "من هي", "الحالي", "الحالية", "رئيس", "عميد", "مدير", "رئيسة", "الآن", "حالياً",
]
RERANK_STATE_EN = [
    "who is", "who are", "current", "president", "dean", "head of", "director", "registrar",
    "now", "currently",
]
RERANK_STATE_AR = ["من هو", "من هي", "الحالي", "الحالية", "رئيس", "عميد", "مدير"]

# Phrases in replies.
REFUSAL_AR = ["لا تتوفر", "لا يوجد", "لا أملك", "لا أعرف", "غير متوفر"]
REFUSAL_EN = ["i cannot", "i can't", "not available", "i don't have"]
ERROR_MARKERS = ["حدث خطأ", "عذراً، حدث", "error occurred", "sorry, an error"]
NO_CONTEXT_AR = (
    "عذراً، لم أتمكن من العثور على معلومات ذات صلة في قاعدة المعرفة. "
    "يرجى إعادة صياغة السؤال أو التواصل مع القسم المختص."
)
NO_CONTEXT_EN = (
    "Sorry, I couldn't find relevant information in the knowledge base. "
    "Please rephrase your question or contact the relevant department."
)
DEFAULT_PREVIEW = "محادثة جديدة"

# Arabic stop words (entries with a space are phrases).
ARABIC_STOPWORDS = [
    "انا", "انت", "انتي", "هو", "هي", "نحن", "هم", "هن", "انتم",
    "في", "من", "الى", "على", "عن", "مع", "بعد", "قبل", "بين", "خلال",
    "عند", "حتى", "لكن", "واو", "او", "ام", "اذا", "لو", "ان", "اذ",
    "ال", "هذا", "هذه", "ذلك", "تلك", "كل", "بعض", "اي",
    "هل", "كان", "يكون", "اريد", "اود", "احتاج", "عندي", "لدي",
    "يوجد", "توجد", "موجود", "موجوده",
    "ما", "ماذا", "متى", "اين", "كيف", "لماذا", "لم", "كم", "ماهو", "ماهي",
    "مرحبا", "السلام", "عليكم", "اهلا", "وسهلا", "شكرا", "جزيلا",
    "يمكن", "ممكن", "برجاء", "رجاء", "من فضلك", "لو سمحت",
    "اخبرني", "اخبر", "قل", "وضح", "شرح",
]
# The common published English stop list.
ENGLISH_STOPWORDS = [
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "you're", "you've", "you'll", "you'd",
    "your", "yours", "yourself", "yourselves", "he", "him", "his", "himself", "she", "she's", "her", "hers",
    "herself", "it", "it's", "its", "itself", "they", "them", "their", "theirs", "themselves", "what",
    "which", "who", "whom", "this", "that", "that'll", "these", "those", "am", "is", "are", "was", "were",
    "be", "been", "being", "have", "has", "had", "having", "do", "does", "did", "doing", "a", "an", "the",
    "and", "but", "if", "or", "because", "as", "until", "while", "of", "at", "by", "for", "with", "about",
    "against", "between", "into", "through", "during", "before", "after", "above", "below", "to", "from",
    "up", "down", "in", "out", "on", "off", "over", "under", "again", "further", "then", "once", "here",
    "there", "when", "where", "why", "how", "all", "any", "both", "each", "few", "more", "most", "other",
    "some", "such", "no", "nor", "not", "only", "own", "same", "so", "than", "too", "very", "s", "t", "can",
    "will", "just", "don", "don't", "should", "should've", "now", "d", "ll", "m", "o", "re", "ve", "y", "ain",
    "aren", "aren't", "couldn", "couldn't", "didn", "didn't", "doesn", "doesn't", "hadn", "hadn't", "hasn",
    "hasn't", "haven", "haven't", "isn", "isn't", "ma", "mightn", "mightn't", "mustn", "mustn't", "needn",
    "needn't", "shan", "shan't", "shouldn", "shouldn't", "wasn", "wasn't", "weren", "weren't", "won", "won't",
    "wouldn", "wouldn't",
]
# Stop list of the English search field.
SEARCH_STOPWORDS = [
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no",
    "not", "of", "on", "or", "such", "that", "the", "their", "then", "there", "these", "they", "this", "to",
    "was", "will", "with",
]

# Arabic affixes, tried in this order.
ARABIC_PREFIXES = ["وال", "بال", "كال", "فال", "لل", "ال", "و", "ف", "ب", "ك", "ل", "س"]
ARABIC_SUFFIXES = [
    "كما", "كم", "كن", "هم", "هن", "نا", "ها", "ات", "ون", "ين", "ان", "ية", "يه", "ة",
]

# Entity types with their priority (lower wins).
ENTITY_PRIORITY = {
    "COURSE_CODE": 1, "COURSE_NUMBER": 1, "STUDENT_ID": 1, "DATE": 2, "CREDIT_HOURS": 3,
    "GRADE": 4, "PERSON": 5, "ACADEMIC_STATUS": 6, "SEMESTER": 7, "COURSE_NAME": 8,
    "DEPARTMENT": 8, "AMOUNT": 9,
}
# Department digit of a student number.
DEPARTMENT_CODES = {
    "1": "Computer Science", "2": "Computer Engineering", "3": "Information Technology",
    "4": "Electrical Engineering", "5": "Mechanical Engineering", "6": "Civil Engineering",
    "7": "Business Administration", "8": "Architecture", "9": "Pharmacy",
}
ID_YEAR_MIN, ID_YEAR_MAX = 10, 30
COURSE_PREFIXES = [
    "CS", "CIS", "IT", "ENGL", "MATH", "PHYS", "CHEM", "BIO", "BUS", "NURS", "PHAR", "ARCH", "CE", "EE", "ME",
    "IE", "SE", "AI", "DS", "NET", "SEC", "SC", "GE", "AB", "ARE", "AC",
]
# Academic status terms.
STATUS_AR = [
    "ناجح", "راسب", "غير مجتاز", "مسجل حالياً", "لم يسجل", "منسحب", "مؤجل", "محول", "مفصول",
]
STATUS_EN = [
    "passed", "failed", "not passed", "currently enrolled", "not registered", "withdrawn",
    "deferred", "transferred", "dismissed", "pass", "fail", "incomplete",
]

# Gazetteers.
DEPARTMENTS_AR = [
    "هندسة الحاسوب", "هندسة الكهرباء", "هندسة المدني", "هندسة الميكانيك", "هندسة الاتصالات",
    "هندسة الكيمياء", "علم الحاسوب", "علوم الحاسوب", "تكنولوجيا المعلومات", "نظم المعلومات",
    "الذكاء الاصطناعي", "علم البيانات", "امن المعلومات", "ادارة الاعمال", "المحاسبة", "التسويق",
    "الاقتصاد", "الصيدلة", "التمريض", "الطب", "العمارة", "الهندسة المعمارية", "الرياضيات",
    "الفيزياء", "الكيمياء", "الاحياء",
]
SEMESTERS_AR = [
    "الفصل الاول", "الفصل الثاني", "الفصل الثالث", "الفصل الرابع", "الفصل الخامس",
    "الفصل السادس", "الفصل السابع", "الفصل الثامن", "الفصل الصيفي", "الفصل الدراسي الاول",
    "الفصل الدراسي الثاني", "الربيع", "الخريف", "الصيف", "فصل الربيع", "فصل الخريف", "فصل الصيف",
    "فصل اول", "فصل ثاني", "فصل ثالث", "فصل رابع", "ترم اول", "ترم ثاني", "ترم ثالث",
    "الترم الاول", "الترم الثاني", "الترم الثالث",
]
COURSES_AR = [
    "أنظمة الوكلاء المتنقلة", "الحقيقة الافتراضية", "توجهات حديثة في تكنولوجيا المعلومات",
    "مواضيع خاصة", "تفاعل الإنسان والحاسوب", "أمن المعلومات", "هندسة برمجيات متقدمة",
    "مبادىء الرسم الحاسوبي", "الأنظمة الموزعة", "مبادىء المترجمات", "البرمجة المرئية",
    "برمجة النظم", "تقنيات برمجية عصرية", "النمذجة والمحاكاة", "مقدمة في انظمة التشفير",
    "تطوير تطبيقات المحمول", "الحوسبة السحابية", "الحوسبة المتوازية", "الأنظمة الخبيرة",
    "الويب الدلالي", "معالجة الصور", "نظم المعلومات الحيوية", "تطوير تطبيقات المحمول المتقدمة",
    "استرجاع المعلومات", "إظهار البيانات", "مخزن البيانات", "معالجة اللغة الطبيعية",
    "مقدمة الى التعلم العميق", "مقدمة الى البيانات الضخمة", "استرجاع المعلومات للوسائط المتعددة",
    "مواضيع خاصة في علم البيانات", "تطوير الويب لعلم البيانات", "إنجليزي A2", "إنجليزي B1",
    "إنجليزي B2", "لغة عربية", "تفاضل وتكامل 1", "تفاضل وتكامل 2", "فيزياء 1", "فيزياء 2",
    "مختبر فيزياء 1", "مختبر فيزياء 2", "الأحياء العامة 1", "الاحياء العامة2",
    "مختبر احياء عامة 1", "مختبر الاحياء العامة2", "التدريب الميداني 1", "التدريب الميداني 2",
    "الحاسوب واساسيات البرمجة", "كيمياء عامة 1", "كيمياء عامة 2", "مختبر كيمياء عامة 1",
    "مختبر كيمياء عامة 2", "المهارات الحياتية", "التربية الرياضية",
    "مختبر الحاسوب واساسيات البرمجة", "تنمية تطوير الأعمال المستدام", "الريادة المستدامة",
    "الرياضيات المتقطعة", "تاريخ فلسطين الحديث", "برمجة الحاسوب", "مختبر تطبيقات أنظمة التشغيل",
    "ثقافة اسلامية", "جبر خطي 1", "لغة عبرية", "التنميه في الوطن العربي", "مشكلات معاصرة",
    "لغة فرنسية", "الاتصال الفعال", "لغة اسبانية", "لغة المانية", "القانون في خدمة المجتمع",
    "الديمقراطية وحقوق الإنسان", "تاريخ العلوم عند العرب والمسلمين", "تركيب البيانات",
    "الحديقه المنزليه", "اللغة التركية", "أخلاقيات الحاسوب وأمن المعلومات", "المنطق الرقمي",
    "النزاهة والشفافية ومكافحة الفساد", "الحركة الأسيرة الفلسطينية", "علم النفس العام",
    "الاحتمالات والاحصاء", "تصميم وتحليل الخوارزميات", "برمجة الكيانات", "تنظيم وعمارة الحاسوب",
    "الاستخدام الفعال للغة الانجليزية", "الريادة", "اساليب البحث العلمي", "تحليل عددي",
    "نظم قواعد البيانات", "لغات البرمجة", "ادارة واقتصاد", "مقدمة الى علم البيانات",
    "مبادىء الذكاء الاصطناعي", "برمجة قواعد البيانات", "برمجة الانترنت", "نظم التشغيل",
    "هندسة البرمجيات", "نظرية الحوسبة", "تعلم الالة", "قواعد البيانات غير العلائقية",
    "مقدمة مشروع التخرج", "شبكات الحاسوب", "مختبر هندسة البرمجيات", "مشروع التخرج", "مساق حر",
]
DEPARTMENTS_EN = [
    "computer science", "computer engineering", "electrical engineering", "civil engineering",
    "mechanical engineering", "business administration", "information technology", "architecture",
    "pharmacy", "nursing", "applied mathematics", "physics", "chemistry",
    "artificial intelligence", "data science", "information security",
]
SEMESTERS_EN = [
    "spring semester", "fall semester", "summer semester", "first semester", "second semester",
    "third semester", "fourth semester", "fifth semester", "sixth semester", "seventh semester",
    "eighth semester", "spring", "fall", "summer",
]
COURSES_EN = [
    "software engineering", "data structures", "algorithms", "operating systems",
    "database systems", "computer networks", "artificial intelligence", "machine learning",
    "natural language processing", "digital logic", "calculus", "linear algebra",
    "discrete mathematics", "object oriented programming", "information security",
    "mobile application development", "cloud computing", "data visualization", "data mining",
    "deep learning", "big data", "information retrieval", "semantic web", "computer graphics",
    "distributed systems", "compilers", "visual programming", "cryptography", "expert systems",
    "image processing", "bioinformatics", "human computer interaction",
]
# Attached prepositions tried after the plain keyword, in this order.
ATTACHED_TO_ARTICLE = ["لل", "بال", "كال", "وال", "فال"]
ATTACHED_PLAIN = ["لل", "بال", "ل", "ب", "و", "ف", "ك"]

# Words that mark credit hours after a number.
CREDIT_TERMS = [
    "ساعة", "ساعات", "ساعه", "معتمدة", "معتمد", "س.م", "credit", "credits", "hour", "hours",
    "hrs", "cr",
]
