"""Fixed values of the domain: categories, keyword lists, thresholds and codes. Data, not logic."""

from __future__ import annotations

# Tax, rounding and order rules.
VAT_RATE = "0.22"
MINIMUM_ORDER_CODE = "базовая_стоимость"
SAMPLE_PREP_CODE = "базовая_подготовка_образцов"

# Order of price categories; any other category comes last.
CATEGORY_ORDER = ["Административная работа", "Подготовка к испытаниям", "Конструкция", "Физико-механические параметры", "Электрические параметры НЧ", "Электрические параметры ВЧ", "Оптические параметры", "Механические воздействия", "Внешние воздействующие факторы", "Пожарная безопасность"]

# Words in a test's name that decide how it is priced.
PER_GROUP_WORDS = ["емкост", "индуктивн", "затухан", "волнов"]
PER_CORE_WORDS = ["сопротивлен"]
PER_GROUP_RESISTANCE_WORDS = ["связи", "экранирован", "излучен"]
FIXED_RATE_PAIRS = [("сопротивлен", "связ"), ("затухан", "экранир"), ("затухан", "излучен")]
FIXED_RATE_CODES = ["измерение_сопротивления_связи", "измерение_затухания_экранирования", "измерение_затухания_излучения"]
CLIMATIC_WORDS = ["пониженной температуре", "повышенной температуре", "изменению температур", "повышенной влажности", "солнечной радиации"]
CLIMATIC_CONTEXT = ("внешние воздействующие", "стойкость", "выдержка")
RULE_LABELS = {"fixed": "фикс", "per_core": "× жилы", "per_group": "× скрутка", "time_based": "⏱ часы"}
WIRE_PREFIXES = ["ПВ", "ПГВ", "АПВ", "ПРГА", "ПРВ", "РКГМ", "ПУГВ", "ПУГП"]

# Words that open a test's name.
OPENING_WORDS = ["Проверка", "Испытание", "Измерение", "Стойкость"]

# Kinds of tests by words in a document, in order; the last is the default.
TEST_TYPES = [("мси", ["мси", "межлаборатор", "сравнительн"]), ("сертификационные", ["сертификац"]), ("приемосдаточные", ["приемо-сдаточ", "приёмо-сдаточ", "приемосдаточ", "приёмосдаточ", "пс испытан"]), ("контрольные", ["контрольн"]), ("исследовательские", ["исследовательск"]), ("периодические", ["периодич"])]
DEFAULT_TEST_TYPE = "периодические"

# Words without meaning in names of tests.
STOP_WORDS = ["к", "и", "на", "в", "по", "при", "с", "от", "до", "для", "или", "из", "ок", "ов", "кабеля", "кабелей", "образцов", "образца", "воздействию", "воздействие", "испытание", "испытания", "проверка", "проверки", "определение", "измерение", "прочность", "стойкость", "угол", "время", "условиях", "условия", "окружающей", "среды", "воздуха", "температуре", "температур", "температуры"]

#: Name matching by shared words: least score, least shared words, and the score that needs no second word.
JACCARD_MIN, SHARED_MIN, JACCARD_ALONE = 0.42, 2, 0.55
#: Fuzzy matching of designations and organisations.
MARK_MIN, MARK_STRICT, ORG_MIN, ORG_CONTAINED, BRAND_MIN = 0.72, 0.86, 0.82, 0.88, 0.82
# How sure a corrected designation is: base, weight of the ratio and most, after spelling and a close name or a close name alone; spelling alone; no change.
CORRECTED_BOTH, CORRECTED_CLOSE, CORRECTED_SPELLING, CORRECTED_NOTHING = (0.75, 0.2, 0.93), (0.70, 0.25, 0.92), 0.88, 0.95
#: Confidence of a synonym that states none.
SYNONYM_CONFIDENCE = 0.7
#: Similar organisations of a name; names that may stand inside a longer one have at least so many characters; known names differ in length by at most so many.
ORG_TOP, INSIDE_MIN, APART_MAX = 8, 8, 3
# Families of designations that are listed by catalogue lines, and what ends a designation's brand (fire class, climate).
CATALOGUE_FAMILIES = ["FLEXICORE", "H07RN", "VICABFLEX"]
FIRE_CLASS = r"(?i)нг\s*\([^)]*\).*$"
CLIMATE_SUFFIX = r"(?iu)-(?:LS|HF|FRLS|FRHF|LSLTx|LSLT|FR|ХЛ|УФ|УХЛ|Т)\b.*$"
#: Aliases shorter than this are matched exactly only.
ALIAS_CONTAINED_MIN = 4
#: Two snapshots differ in quality beyond this margin.
QUALITY_MARGIN = 0.02
#: A text layer with fewer Cyrillic letters than this share, on a page with pictures, is a scan.
CYRILLIC_MIN = 0.2

# Legal forms at the start of an organisation's name, and names that are none.
LEGAL_FORMS = ["общество с ограниченной ответственностью", "ооо", "ао", "пао", "зао"]
PLACEHOLDER_NAMES = ["заказчик", "производитель", "customer", "manufacturer", "unknown"]

# Patterns of kinds of organisations, in order.
ORGANISATION_TYPES = [("testing_center", r"испытательн\w+\s+(?:центр|лаборатор)"), ("certification_body", r"орган\w*\s+по\s+сертификац"), ("designer", r"проектировщик|генпроектировщик|проектн\w+\s+(?:институт|организац|бюро|офис)"), ("dealer", r"\bдилер\w*\b"), ("manufacturer", r"кабельн\w+\s+завод|завод\w*|производител\w*|изготовител\w*")]
TESTING_CENTER = r"испытательн\w*\s+(?:центр|лаборатор)"

# Patterns of contact details in a letter's head.
TAX_IDS = r"ИНН\s*/?\s*КПП\s*(\d{10,12})\s*/\s*(\d{9})"
TAX_ID = r"ИНН\s*(\d{10,12})"
PHONE = r"(?:Тел|Tex|тел|т/ф|Факс|факс)\s*[.:]?\s*(\+?\d[\d\s()\-]{9,35})"
EMAIL = r"(?:E-?mail|электронн\w*\s*почт\w*)\s*[.:]?\s*([\w.\-]+@[\w.\-]+\.\w+)"
RECIPIENT = r"^(?:Генеральному|Уважаемому)\s+(?:(?:директору|директора)\s+)?(.+)$"
SENDER = r"ООО\s*[«\"]([^»\"]+)[»\"]"
STREET = r"\b(?:Ул\.?|ул\.?)\s*:?\s*([^,;\n]+(?:,\s*[^,;\n]+){0,6})"

# Norm documents, by preference, and words that rule one out.
NOT_A_DOCUMENT = r"стоимост|срок|услуг|оплат|количеств|гарантир|письм|заказ|просьб"

# Words that make a clause of a norm interesting, and tests that are not charged.
NOT_BILLABLE = r"маркиров|упаков|срок\s+служб|комплектност|сопровод"

#: Validation: lengths, factors and penalties.
LONG_NAME, EMPTY_MARKS_CHARS = 80, 500
EDITED = 0.75
OCR_FACTOR, NO_DOCUMENT, DUPLICATE, UNKNOWN_TYPE, NO_TAX_ID = 0.85, 0.10, 0.05, 0.10, 0.15

# What may follow a fire class in a designation; words of a line that greets a letter's recipient.
FIRE_SUFFIXES = ["FRLS", "FRHF", "LSLTX", "LSLT", "LS", "HF", "FR", "ХЛ", "УФ", "УХЛ", "Т", "NG"]
SALUTATIONS = ["генеральному", "уважаемому"]

# Folders that are never a customer's name, words that tell an organisation, and how marks and logins look.
PASSED_FOLDERS = ["user", "users", "users_folder$", "user_folder$", "user_data", "temp", "tmp", "inbox", "download", "downloads", "request_processor", "обработка заявок", "расчёты для заказчиков", "расчеты для заказчиков", "документ", "документы", "data", "generated", "extracted", "appdata", "local", "roaming", "desktop", "document", "documents"]
ORGANISATION_WORDS = ["ооо", "ано", "оао", "зао", "пао", "llc", "ltd", "jsc"]
ORGANISATION_ENDINGS = ["ип", "inc"]
TRADE_WORDS = ["сертифик", "завод", "кабел"]
MARK_BEGINNINGS = ["лпмф", "ввг", "квв", "квг"]
