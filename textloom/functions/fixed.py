"""Patterns, words and labels whose exact form decides results. Patterns are in Java's syntax."""

# Point numbers, in the order in which they are tried; group 1.
POINT_NUMBER = (
    r"(?U)^\s*\{([^}]*\d[^}]*)\}",
    r"(?U)^\s*(\d+(?:[\.\-]\d+)+)(?=\s)",
    r"(?U)^\s*(\d+(?:[\.\-]\d+)*)\.",
    r"(?iuU)^\s*пункт[ае]?\s+(\d+(?:[\.\-]\d+)*)",
)

# Paragraphs that are skipped, as full matches.
SKIPPED = (
    r"(?U)^[-–—]?\s*\d+\s*[-–—]?$",
    r"(?iuU)^Страница\s+\d+$",
    r"(?iuU)^Переход к Содержанию документа осуществляется по ссылке$",
)

# Headings.
HEADING_STYLE = r"(?U)(heading|заголовок)\s*(\d+)"
HEADING_STANDARD = r"(?iuU)^ГОСТ\s+(?:Р\s+)?[A-Za-zА-Яа-я0-9.\-]+"
HEADING_DIRECTIVE = r"(?iuU)^(?:СО|РД)\s+\d+(?:[.\-]\d+)+"
HEADING_PART = r"(?iuU)^(Раздел|Глава|Статья)\s+[IVXLCDM0-9]+"
HEADING_ROMAN = r"(?U)^[IVXLCDM]+\.\s+\S+"
HEADING_NUMBERED = r"(?U)^\d+\s+[А-ЯЁ][^.:;]{4,}$"
HEADING_CAPITALS = r"[А-ЯЁ]{4,}"
HEADING_CAPITALS_NOT = r"(?U)\d{4}|\bN\b|ГОСТ\s+\d"
STRUCTURED_HEADING = {
    "article": r"(?iuU)^\s*Статья\s+([0-9]+(?:[._][0-9]+)*)\.?\s*(.*)$",
    "chapter": r"(?iuU)^\s*Глава\s+([0-9]+(?:[._][0-9]+)*)\.?\s*(.*)$",
    "section": r"(?iuU)^\s*Раздел\s+([IVXLCDM0-9]+)\.?\s*(.*)$",
}

# Document metadata.
DOC_TYPES = ("ПРИКАЗ", "ПОСТАНОВЛЕНИЕ", "РАСПОРЯЖЕНИЕ", "УКАЗ")
NOT_STATED = "Не указано"
REGISTRATION_LINE = r"(?iuU)^от\s+.+?(?:[Nn№])\s*[A-Za-zА-Яа-я0-9\-/]+"
APPROVAL_ACT = (
    r"(?iuU)((?:Приказом|Постановлением|Распоряжением)[^.]{0,240}?от\s+(?:\d{1,2}[._\s]\d{1,2}[._\s]\d{4}|\d{1,2}\s+[А-Яа-я]+\s+\d{4})(?:\s*г\.?)?[^.]{0,120}?(?:[Nn№])\s*[A-Za-zА-Яа-я0-9\-/]+)",
    r"(?isuU)(Утвержден[оа]\s+.+?приказ\s+от\s+(?:\d{1,2}[._\s]\d{1,2}[._\s]\d{4}|\d{1,2}\s+[а-яёА-ЯЁ]+\s+\d{4})(?:\s*г\.?)?.*?(?:[Nn№])\s*\d+)",
)
LAW_MARKS = r"(?U)ФЕДЕРАЛЬНЫЙ ЗАКОН|\bКОДЕКС\b"
LAW_NUMBER = r"(?iuU)^(?:[Nn№])\s*(\d+\s*-\s*ФЗ)\.?\s*$"
LAW_DATE = r"(?iuU)^\d{1,2}\s+[а-яёА-ЯЁ]+\s+\d{4}\s*года?\s*$"
RULES_MARKS = r"ПУЭ|ПРАВИЛА УСТРОЙСТВА"
RULES_ACT = "Приказом Министерства энергетики Российской Федерации от 8 июля 2002 г. № 204"
RULES_DATE = "1 января 2003"
RULES_AUTHORITY = "Министерство энергетики Российской Федерации"
TITLE_WORDS = ("ОБ УТВЕРЖДЕНИИ", "О ВНЕСЕНИИ", "ПРАВИЛ", "ТРЕБОВАН", "ГОСТ", "ФЕДЕРАЛЬНЫЙ ЗАКОН", "КОДЕКС", "УСТАВ")
DOC_KINDS = (
    ("law", r"(?U)ФЕДЕРАЛЬНЫЙ ЗАКОН|\bЗАКОН\b"),
    ("decree", r"ПОСТАНОВЛЕНИЕ"),
    ("decree", r"РАСПОРЯЖЕНИЕ"),
    ("order", r"ПРИКАЗ"),
    ("gost", r"ГОСТ"),
    ("pue", r"ПУЭ|ПРАВИЛА УСТРОЙСТВА ЭЛЕКТРОУСТАНОВОК"),
)
DOC_KIND_LABELS = {
    "law": "федеральный закон",
    "decree": "постановление",
    "order": "приказ",
    "gost": "ГОСТ",
    "pue": "приказ",
    "unknown": "не классифицировано",
}
STANDARD_NUMBER = r"(?iuU)\bГОСТ\s+(?:Р\s+)?([A-Za-zА-Яа-я0-9.\-]+)"
ANY_NUMBER = r"(?U)(?:[Nn№])\s*([A-Za-zА-Яа-я0-9\-/]+)"
LAW_CODE = r"(?iuU)\b(\d+\s*-\s*ФЗ)\b"
DOC_DATE = r"(?iuU)от\s+(\d{1,2}[._\s]\d{1,2}[._\s]\d{4}|\d{1,2}\s+[А-Яа-я]+\s+\d{4})"
GOVERNMENT, GOVERNMENT_MARK = "Правительство РФ", "правительств"
STANDARDS_BODY, STANDARDS_BODY_MARKS = "Росстандарт", ("федерального агентства по техническому регулированию", "росстандарт")
ENERGY_MARK = r"(?U)минэнерго(\s+россии)?\b"
MINISTRY = r"(?iuU)(Министерств[ао].{0,120}?)(?:\s+от\b|[,.;]|$)"
AUTHORITY_BY_LABEL = {
    "федеральный закон": "Федеральное Собрание Российской Федерации; Президент Российской Федерации",
    "постановление": "Правительство Российской Федерации",
    "ГОСТ": "Федеральное агентство по техническому регулированию и метрологии (Росстандарт)",
}
AUTHORITY_PREFERRED = {
    "Правительство РФ": "Правительство Российской Федерации",
    "Росстандарт": "Федеральное агентство по техническому регулированию и метрологии (Росстандарт)",
    "Министерства энергетики Российской Федерации": "Министерство энергетики Российской Федерации",
    "Министерством энергетики Российской Федерации": "Министерство энергетики Российской Федерации",
}
AUTHORITY_ALIASES = {
    "минэнерго": "Министерство энергетики Российской Федерации",
    "минэнерго россии": "Министерство энергетики Российской Федерации",
    "федерального агентства по техническому регулированию": "Федеральное агентство по техническому регулированию и метрологии (Росстандарт)",
}
MINISTRIES = (
    "Министерство внутренних дел Российской Федерации",
    "Министерство иностранных дел Российской Федерации",
    "Министерство обороны Российской Федерации",
    "Министерство юстиции Российской Федерации",
    "Министерство финансов Российской Федерации",
    "Министерство экономического развития Российской Федерации",
    "Министерство промышленности и торговли Российской Федерации",
    "Министерство энергетики Российской Федерации",
    "Министерство транспорта Российской Федерации",
    "Министерство строительства и жилищно-коммунального хозяйства Российской Федерации",
    "Министерство природных ресурсов и экологии Российской Федерации",
    "Министерство сельского хозяйства Российской Федерации",
    "Министерство науки и высшего образования Российской Федерации",
    "Министерство просвещения Российской Федерации",
    "Министерство культуры Российской Федерации",
    "Министерство здравоохранения Российской Федерации",
    "Министерство труда и социальной защиты Российской Федерации",
    "Министерство цифрового развития, связи и массовых коммуникаций Российской Федерации",
    "Министерство Российской Федерации по делам гражданской обороны, чрезвычайным ситуациям и ликвидации последствий стихийных бедствий",
    "Министерство спорта Российской Федерации",
)

# Retrieval and query understanding.
KEYWORD_FIELDS = ("chunk_id", "doc_name", "filename", "point_identity_key", "point_number")
TEXT_FIELDS = ("heading_path_text", "text")
SEARCH_FIELDS = ("text", "heading_path_text", "doc_name", "filename")
ORDER_NUMBER = (
    r"(?iuU)(?:приказ|постановление|распоряжение).*?(?:№|n\.?|номер)\s*(\d+)",
    r"(?iuU)(?:№|n\.?)\s*(\d+)",
    r"(?iuU)\bn[_\s]*(\d+)\b",
)
POINT_HINT = r"(?iuU)(?:п\.?|пункт|п\.?\s*)\s*(\d+(?:\.\d+)*)|(?:^|\s)(\d+\.\d+(?:\.\d+)*)\s"
KNOWN_ALIASES = {
    "пуэ": ("правила устройства электроустановок", "электроустановок"),
    "птэ": ("правила технической эксплуатации", "технической эксплуатации"),
    "озп": ("отопительный сезон", "готовности"),
}
TOOLS = ("point", "payload", "vector")
TOOL_PRIORITY = {"point": 0, "payload": 1, "vector": 2, "hybrid": 3}
RRF_K = 60
FALLBACK_MARKERS = (
    "used deterministic routing",
    "used passthrough ordering",
    "used evidence-only answer",
    "prompt planner failed",
    "prompt reranker failed",
    "prompt final answer failed",
    "provider not configured",
    "returned no valid tools",
    "returned no valid items",
    "returned no valid citations",
)

# What every chunk's payload must have.
REQUIRED_PAYLOAD = (
    "filename", "doc_name", "doc_reg", "doc_title_full", "approving_act", "metadata_source", "metadata_confidence",
    "headings", "nearest_heading", "heading_path_text", "chapter_heading", "chapter_number", "chapter_title",
    "section_heading", "section_number", "section_title", "article_heading", "article_number", "article_title",
    "retrieval_anchor_heading", "point_number", "point_scope", "point_anchor", "point_identity_key", "chunk_index",
    "chunk_start", "part_index", "total_parts", "is_split",
)

# Knowledge tables and document candidates.
MOST_ABBREVIATIONS, MOST_TERMS, MOST_GRAPH_ABBREVIATIONS = 2500, 4000, 1500
ABBREVIATION = r"^[A-Za-zА-Яа-яЁё0-9.\-]+$"
NO_TERM = ("Таблице", "Стандарт [")
LEAST_ALIKE = 0.55
KNOWLEDGE_SCORES = {
    "doc_name_contains_query": 0.45,
    "query_contains_doc_name": 0.35,
    "doc_name_token_overlap": 0.5,
    "annotation_contains_query": 0.35,
    "annotation_token_overlap": 0.45,
    "fuzzy_doc_name": 0.25,
    "topic_alias": 0.72,
    "abbreviation": 0.48,
    "term": 0.42,
}

# Query plans and runtime profiles (default limit, tools, fusion).
MOST_QUERIES = 4
PROFILES = {
    "fast": {"limit": 5, "tools": ("point", "payload", "vector"), "hybrid": False},
    "balanced": {"limit": 10, "tools": ("point", "payload", "vector"), "hybrid": True},
    "deep": {"limit": 20, "tools": ("point", "payload", "vector"), "hybrid": True},
}
EXPECTED_PAYLOAD_INDEXES = {
    "chunk_id": "keyword",
    "doc_name": "keyword",
    "filename": "keyword",
    "point_identity_key": "keyword",
    "point_number": "keyword",
    "text": "text",
    "heading_path_text": "text",
}
INDEX_DEFECTS = (
    ("chunks_total", "no_chunks", "indexing"),
    ("chunks_missing_required_payload_keys", "missing_required_payload_keys", "payload"),
    ("payload_errors", "payload_errors", "payload"),
    ("empty_text_chunks", "empty_vector_text", "embedding"),
    ("duplicate_index_ids", "duplicate_index_ids", "index"),
)
