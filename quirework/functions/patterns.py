"""Patterns, markers and lists that results depend on."""

# Characters that text normalisation deletes or turns into a space.
ZERO_WIDTH = "\u200b\ufeff\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2066\u2067\u2068\u2069"
EXOTIC_SPACES = "\u00a0\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
SOFT_HYPHEN, HYPHEN_BREAK = "\u00ad", "\ue000"
EASTERN_DIGITS = "۰۱۲۳۴۵۶۷۸۹٠١٢٣٤٥٦٧٨٩"
PERSIAN_DIGITS = "۰۱۲۳۴۵۶۷۸۹"

# Front matter.
FRONT_MATTER = (
    r"^\s*correspondence\b",
    r"^\s*(?:received|revised|accepted|published)\b\s*[:.]",
    r"^\s*(?:keywords?|key\s+words)\b\s*[:.]",
    r"^\s*(?:article id|article number|academic editor|reviewed by)\b",
    r"^\s*orcid\b",
    r"\bthis is an open access article\b",
    r"\bcreative commons attribution\b",
    r"\blicensed under\b",
    r"\bterms and conditions\b",
    r"\bdownloaded from\b",
    r"\bwiley online library\b",
)

# Running headers; the one that starts with (?-i) heeds case.
RUNNING_HEADER = (
    r"^\s*(?:page\s*)?\d{1,4}\s*(?:of\s*\d{1,4})?\s*$",
    r"^\s*page\s+\d+",
    r"\d+\s+of\s+\d+",
    r"case reports? in\b",
    r"\bhindawi\b",
    r"\bwiley\b",
    r"\belsevier\b",
    r"\bspringer\b",
    r"(?-i)\bmDPI\b",
    r"\bdoi\s*[:.]",
    r"\bhttps?://",
    r"\bwww\.",
    r"\bonlinelibrary\b",
    r"\bdownloaded from\b",
    r"\bterms and conditions\b",
    r"\bcreative commons\b",
    r"\ball rights reserved\b",
    r"\bcopyright\b",
    r"\blicensed under\b",
    r"^\s*(?:volume|vol\.|issue|no\.)\s*\d",
    r"\b(?:journal|international journal|journal of)\b",
    r"\bpublishing (?:corporation|corp|group|ltd)\b",
    r"\b(?:received|revised|accepted|published|available online)\b\s*[:.]",
    r"\borcid\b",
    r"^\s*keywords?\b\s*[:.]?",
    r"^\s*key\s+words\b\s*[:.]?",
    r"^\s*correspondence\b",
    r"^\s*(?:article id|article number|editor|reviewed by|academic editor)\b",
    r"^\s*open access\b",
    r"^\s*\d{4}\s+\w+\s*(?:\.|$)",
)

# Affiliations, references, captions, cells, numbers.
AFFILIATION = r"^\s*(?:\d+\s*)?(?:department|division|school|faculty|college|university|hospital|institute|institution|clinic|center|centre|graduate school|oral and maxillofacial|دپارتمان|دانشکده|دانشگاه|بیمارستان)\b"
REFERENCE_ITEM = r"^\s*(?:\[\d+\]|\d{1,2}\.)\s+[A-Z]"
REFERENCE_MARKER = r"^\s*(?:\[(\d{1,3})\]|(\d{1,2})[\.\)])\s+"
REFERENCE_SPLIT = r"""(?:^|(?<=\s))(?:\[\d{1,3}\]|\d{1,2}[\.\)])[ \t\u202f]+(?=[A-Z\u201c"'\(]|[\u0600-\u06FF])"""
CAPTION = r"^\s*(?:Figure|Fig\.|Fig|Image|شکل)\s*(\p{Nd}+)[\.:\s\-]"
TEXTUAL_CELL = r"[A-Za-z\u0600-\u06FF]{2,}"
NUMBER = r"\d+(?:[.,]\d+)?"

# Measurement units.
UNITS = (
    "mmol/L", "mol/L", "mg/dL", "µg/mL", "ug/mL", "mcg/mL", "ng/mL", "pg/mL", "mm/s", "cm/s", "m/s", "km/h", "mmol", "µmol", "umol", "mcg", "µg", "ug", "ng", "pg", "mg", "kg", "mL", "ml", "dL", "L", "cm", "mm", "µm", "um",
    "nm", "kPa", "MPa", "Pa", "Gy", "mSv", "Sv", "Hz", "kHz", "MHz", "W", "V", "mA", "A", "min", "sec", "h", "°C", "°F", "%", "rpm", "N", "Ncm", "mm²", "cm²",
)

# Replies that ask for text instead of translating it.
ASKING_MARKERS = ("please provide", "please send", "send the", "provide the text", "text you'd like", "text you would like", "i'd be happy to translate", "ارسال کنید تا ترجمه", "متن مورد نظر را ارسال", "لطفا متن", "لطفاً متن", "متنی برای ترجمه")

# Failures that may pass, and failures that will not.
TRANSIENT_MARKERS = ("rate limit", "too many requests", "overloaded", "timeout", "timed out", "temporarily unavailable", "server error", "bad gateway", "service unavailable", "gateway timeout")
PERMANENT_STATUS = (400, 401, 403, 404, 422)
PERMANENT_MARKERS = (
    "connection refused", "connection error", "apiconnectionerror", "invalid api key", "incorrect api key", "unauthorized", "authentication", "permission denied", "model not found", "does not exist", "no such model",
    "unsupported model", "name resolution", "getaddrinfo", "nodename nor servname", "no address associated", "ssl", "certificate verify failed", "inference_failed",
)

# Section names, and the headings that open and close a bibliography.
SECTION_NAMES = (
    "Abstract", "Introduction", "Background", "Case Report", "Case Presentation", "Case Description",
    "Case Series", "Clinical Findings", "Observation", "Observations", "Materials and Methods",
    "Patients and Methods", "Methods", "Methodology", "Results", "Discussion", "Conclusion", "Conclusions",
    "References", "Bibliography", "Literature Cited", "Acknowledgements", "Acknowledgments",
    "Conflict of Interest", "Conflicts of Interest", "Competing Interests", "Declaration of Competing Interest",
    "Author Contributions", "Authors' Contributions", "Funding", "Funding Statement", "Ethics Statement",
    "Ethical Approval", "Consent", "Patient Consent", "Data Availability Statement", "Data Availability",
    "Supporting Information", "Abbreviations", "Limitations", "Appendix", "Supplementary Material", "ORCID",
)
HEADING = (
    rf"^\s*(?:\d+\s*[\.\)\|:]?\s*)?(?:{'|'.join(SECTION_NAMES)})\s*[:.]?\s*$",
    r"(?-i)^\s*\d+\s*\|\s*[A-Z]",
    rf"^\s*(?:\d+\s*[\.\)\|:]\s*)?(?:{'|'.join(SECTION_NAMES)})\b",
)
REFERENCE_SECTION = (r"^\s*(?:\d+\s*[\.\)\|:]\s*)?(references|bibliography|literature cited|منابع|مراجع|منابع و مراجع)\s*[:.]?\s*$",)
OTHER_SECTION = (r"^\s*(?:\d+\s*[\.\)\|:]\s*)?(acknowledg\w*|conflict\w*|competing\w*|declaration of competing\w*|author contributions|authors' contributions|funding\w*|ethics\w*|ethical approval|consent\w*|data availability|supporting information|abbreviations|appendix|supplementary\w*|orcid|conclusion\w*|discussion|abstract)\b",)

# Bylines.
NAME_TOKEN = r"[A-Z][a-z]+(?:[-'][A-Z]?[a-z]+)?\d*"
NAMEY_TOKEN = r"(?:[A-Z][a-z]+(?:[-'][A-Z]?[a-z]+)?\d*|[A-Z]{1,4}\.?\d*|\d{1,2})"
BYLINE_SPLIT = r"[\s|,;•&]+"
PARTICLES = (
    "de", "van", "von", "der", "den", "del", "della", "la", "le", "el", "bin", "binti",
    "ibn", "and", "or", "et", "al", "jr", "sr", "ii", "iii", "md", "dds", "phd", "msc",
    "bds", "mds", "of", "the", "in", "on", "for", "university",
)

# Labels that are no terms, and terms that stay as they are.
LABELS = (
    "case report", "case reports", "case presentation", "case description",
    "abstract", "introduction", "discussion", "conclusion", "conclusions",
    "references", "bibliography", "acknowledgements", "acknowledgments",
    "conflict of interest", "conflicts of interest", "author contributions",
)
LABEL_PATTERNS = (
    r"\b(?:department|school|faculty|college|university|hospital|institute|clinic|center|centre|division|unit|academy|society|association)\b",
    r"\b(?:dental school|medical center|health sciences)\b",
    r"\b(?:dentistry|endodontics|periodontics|orthodontics|prosthodontics|restorative dentistry|oral medicine|oral surgery)\b",
)
ANATOMICAL_TERMS = (
    "central incisor", "lateral incisor", "incisor", "canine", "premolar", "molar", "wisdom tooth", "deciduous tooth",
    "primary tooth", "permanent tooth", "maxillary", "mandibular", "mesial", "distal", "buccal", "lingual", "palatal",
    "occlusal", "apical", "coronal", "interproximal", "proximal", "cervical", "radicular",
)
NUMBERED_REPLY = r"^\s*(\d+)\s*[\.\)\-:]?\s*(.+)"

# Hosts a request may name, and image types that go by their own name.
LOOPBACK = ("127.0.0.1", "localhost", "[::1]", "::1")
IMAGE_TYPES = ("png", "jpeg", "webp", "gif")

# The offline glossary, and its headings.
GLOSSARY = {
    "complicated crown-root fracture": "شکستگی پیچیده تاج-ریشه",
    "crown-root fracture": "شکستگی تاج-ریشه",
    "crown fracture": "شکستگی تاج",
    "reattachment procedure": "فرایند اتصال مجدد",
    "reattachment": "اتصال مجدد",
    "single visit technique": "تکنیک تک‌جلسه‌ای",
    "periapical radiograph": "رادیوگرافی پری‌آپیکال",
    "intraoral photograph": "تصویر داخل‌دهانی",
    "intraoral view": "نمای داخل‌دهانی",
    "biological width": "عرض بیولوژیک",
    "periodontal ligament": "رباط پریودنتال",
    "periodontal": "پریودنتال",
    "pulpal exposure": "اکسپوز پالپ",
    "pulp tissue": "بافت پالپ",
    "pulp": "پالپ",
    "root canal treatment": "درمان ریشه دندان",
    "endodontic treatment": "درمان اندودنتیک",
    "composite resin": "کامپوزیت رزین",
    "radiolucent lesion": "ضایعه رادیولوسنت",
    "radiolucent": "رادیولوسنت",
    "radiopaque": "رادیواپک",
    "osteotomy": "استئوتومی",
    "gingivectomy": "ژنژیوکتومی",
    "histopathology": "هیستوپاتولوژی",
    "rubber dam": "رابردم",
    "fiber post": "پست فایبر",
    "light-curing": "لایت کیورینگ",
    "fractured fragment": "قطعه شکسته",
    "coronal fragment": "قطعه تاجی",
}
HEADING_RENDERINGS = {
    "abstract": "چکیده",
    "introduction": "۱. مقدمه",
    "1. introduction": "۱. مقدمه",
    "case report": "گزارش مورد (Case Report)",
    "case presentation": "شرح مورد بالینی (Case Presentation)",
    "case description": "توصیف مورد (Case Description)",
    "discussion": "بحث و بررسی",
    "conclusion": "نتیجه‌گیری",
    "conclusions": "نتیجه‌گیری‌ها",
    "references": "منابع و مراجع",
    "acknowledgement": "تقدیر و تشکر",
    "acknowledgments": "تقدیر و تشکر",
    "conflict of interests": "تضاد منافع",
    "conflicts of interest": "تضاد منافع",
}

# What ends the search for a term before its English name, what breaks it off,
# the words that are no part of a term, and the shapes of names in parentheses.
SENTENCE_END = ".!؟?"
TERM_BOUNDARY = "،؛:.,;!؟?)"
TERM_BARRIER = "()[]«»\"'"
TERM_WORDS, TERM_CHARS = 5, 60
TERM_STOPWORDS = (
    "و", "یا", "با", "از", "به", "در", "بر", "که", "تا", "را", "برای",
    "این", "آن", "هم", "نیز", "اما", "ولی", "روی", "بین", "پس", "مورد",
    "طور", "صورت", "دلیل", "وسیله", "عنوان", "جهت", "بدون", "داخل",
    "شد", "شده", "شود", "کرد", "کرده", "کند", "است", "بود", "گردید",
    "می", "نمی", "دارد", "دارای", "داد", "یافت", "گشت", "انجام",
)
NAME_IN_PARENTHESES = r"\(\s*([A-Za-z][A-Za-z0-9\s,;:\-\./\+%'’]*?)\s*\)"
PLAIN_PARENTHESES = r"(\([A-Za-z0-9\s,;:\-\./\+%]+\))"

# The clinical terms and their renderings.
CLINICAL_TERMS = {
    "Complicated Crown-Root Fracture": "شکستگی پیچیده تاج-ریشه",
    "Crown-Root Fracture": "شکستگی تاج-ریشه",
    "Crown Fracture": "شکستگی تاج",
    "Root Fracture": "شکستگی ریشه",
    "Reattachment Procedure": "روش اتصال مجدد",
    "Reattachment": "اتصال مجدد",
    "Fiber Post": "پست فایبر",
    "Biologic Width": "عرض بیولوژیک",
    "Biological Width": "عرض بیولوژیک",
    "Orthodontic Extrusion": "اکستروژن ارتودنتیک",
    "Isolation": "ایزولاسیون",
    "Protrusive Eruptive Pattern": "الگوی رویش پروتروزیو",
    "Dental Trauma": "تروما دندانی",
    "Traumatic Dental Injuries": "آسیب‌های دندانی تروماتیک",
    "Intraoral": "داخل‌دهانی",
    "Radiograph": "رادیوگراف",
    "Periapical Radiograph": "رادیوگراف پری‌اپیکال",
    "Pulp": "پالپ",
    "Pulpotomy": "پالپوتومی",
    "Pulpectomy": "پالپکتومی",
    "Root Canal Treatment": "درمان کانال ریشه",
    "Composite Resin": "رزین کامپوزیت",
    "Enamel": "مینا",
    "Dentin": "عاج",
    "Cementum": "سِمان",
    "Periodontal Ligament": "لیگامان پریودنتال",
    "Alveolar Bone": "استخوان آلوئولار",
    "Gingiva": "لثه",
    "Vitality Test": "تست وایتالیتی",
    "Percussion Test": "تست پرکاشن",
    "Mobility": "موبیلیتی",
    "Splinting": "اسپلینت‌گذاری",
    "Follow-Up": "پیگیری",
    "Prognosis": "پروگنوز",
    "Anterior Teeth": "دندان‌های قدامی",
    "Posterior Teeth": "دندان‌های خلفی",
    "Apexification": "اپکسیفیکاسیون",
    "MTA": "مینرال تری‌اکساید اگریگیت",
}

# Formats of notes, warnings and captions, and types that are translated.
TERM_NOTE = ("", " در فارسی «", "» ترجمه می‌شود.")
MISSING_NUMBERS, ADDED_NUMBERS, MISSING_UNITS = "اعداد جاافتاده در ترجمه: ", "اعداد اضافه‌شده در ترجمه: ", "واحدهای جاافتاده در ترجمه: "
LIST_COMMA, TIMES = "، ", "×"
CAPTION_PARTS = r"^(?:Figure|Fig\.|شکل)\s*(\p{Nd}+)[\.:\s\-]+(.*)"
FIGURE_WORD = "شکل"
TRANSLATABLE = ("title", "heading", "paragraph", "figure_caption", "reference")
LOCAL_HOSTS = ("127.0.0.1", "localhost", "0.0.0.0", "[::1]")

# Classes of a page's elements.
TERM_OPEN, TERM_MIDDLE, TERM_NAME, TERM_CLOSE = '<span class="glossary-term" data-term="', '" tabindex="0" role="button">', '<span class="term-en" dir="ltr"> (', ")</span></span>"
NAME_OPEN, NAME_CLOSE = '<span class="en-term" dir="ltr">', "</span>"

# Download limits.
DOWNLOAD_LIMIT, FIRST_CHUNK, LEAST_FILE = 150 * 1024 * 1024, 1024, 100
