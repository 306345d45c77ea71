"""Russian language pack: rule data only, no logic.

FIXED VALUES.  Every list, pattern and message below has to equal the expected
behaviour for results to match, so it is stated verbatim in its natural order.
The five stop lists differ from each other on purpose.
"""

# --- stop words -----------------------------------------------------------

RETRIEVAL_STOP = (
    "а без бы был была были быть в вам вас весь во вот все всех где да для до его "
    "ее её если есть еще ещё же за зачем и из или им их к как какая какие какой кем "
    "когда кто ли на над надо не него нее ней нет но о об он она они оно от по под "
    "при про с со так также то у уже что чем чего это эта эти этот должен должна "
    "должны нужно можно порядок каков какова"
).split()

CONTEXT_STOP = (
    "а без бы в во для до его ее её и из или их как какая какие какой кем когда кто ли "
    "на над не но о об от по под при про с со то у что это этот эта эти должен должна "
    "должны нужно можно порядок"
).split()

PLANNER_STOP = (
    "а без бы был была были быть в вам вас во вот все для до его ее её если есть же за и "
    "из или им их к как какая какие какой кем когда кто кому ли на над не нет но о об он "
    "она они оно от по под при про с со так то у что чем чего это эта эти этот почему "
    "зачем куда где расскажи напиши покажи объясни скажи пожалуйста"
).split()

GATE_STOP = (
    "а без бы был была были быть в вам вас во вот все всех где да для до его ее её если "
    "есть еще ещё же за зачем и из или им их к как какая какие какой кем когда кто кому ли "
    "на над надо не него нее ней нет но о об он она они оно от по под при про с со так "
    "также такое такой то у уже что чем чего это эта эти этот должен должна должны нужно "
    "можно делать порядок каков какова напиши расскажи объясни"
).split()

REWRITE_STOP = (
    "а без бы в во для до его ее её и или их как к кто ли на над не но о об от по под при "
    "про с со то у что это этот эта эти они он она оно им ими"
).split()

# --- roots that name the shape of a question, not its object ----------------

GENERIC_ROOTS = (
    "ответс отвеч оформ делат дейст нужн докуме меры безопа срок услов измене соглас "
    "провод провед выполн работ поряд требов долже сообщ входи случа вопрос информ нужны "
    "нужен нужна нужно провер звони звонит продл допуск допуска увиде обнару"
).split()

GENERIC_REWRITE_ROOTS = (
    "оформ измен согла делат дейст поряд требо прово выпол нужн можно должн какие какой"
).split()

# --- query gates: (pattern, answer, reason), matched against the whole query ---

DIRECT_PATTERNS = (
    (r"(?:привет|здравствуй(?:те)?|доброе\s+утро|добрый\s+день|добрый\s+вечер)[!.?\s]*",
     "Здравствуйте! Я готов помочь с вопросами по базе знаний.", "smalltalk_greeting"),
    (r"(?:как\s+дела|как\s+ты|что\s+нового|как\s+настроение|как\s+поживаешь)[!.?\s]*",
     "Всё хорошо. Я готов помочь с вопросами по базе знаний.", "smalltalk_status"),
    (r"(?:(?:привет|здравствуй(?:те)?|добрый\s+(?:день|вечер)|доброе\s+утро)[,!]?\s*)?"
     r"(?:как\s+дела|как\s+ты|как\s+настроение|что\s+нового)[!.?\s]*",
     "Всё хорошо. Я готов помочь с вопросами по базе знаний.", "smalltalk_status"),
    (r"(?:(?:ок|хорошо|понятно)[,!]?\s*)?(?:спасибо(?:\s+большое)?|благодарю|спс)[!.?\s]*",
     "Пожалуйста. Если нужно, задайте следующий вопрос по базе знаний.", "smalltalk_thanks"),
    (r"(?:пока|до\s+свидания|до\s+встречи)[!.?\s]*", "До свидания!", "smalltalk_bye"),
    (r"(?:что\s+ты\s+умеешь|что\s+умеешь|чем\s+можешь\s+помочь|какие\s+вопросы\s+можно\s+задавать)[!.?\s]*",
     "Я отвечаю на вопросы по подключённой базе знаний и показываю источники ответа.",
     "meta_capabilities"),
    (r"(?:помоги|нужна\s+помощь|помощь)[!.?\s]*",
     "Задайте конкретный вопрос по материалам базы знаний — я найду релевантные источники "
     "и отвечу по ним.", "meta_help"),
)

EXTERNAL_PATTERNS = (
    (r"\b(?:погода|прогноз\s+погоды|температур\w*\s+(?:на\s+улице|снаружи))\b", "external_weather"),
    (r"\bкурс\s+(?:доллар\w*|евро|валют\w*)\b", "external_currency"),
    (r"\b(?:рецепт|приготовить|как\s+готовить)\b", "external_recipe"),
    (r"\b(?:матч|счет\s+матча|результат\s+матча)\b", "external_sports"),
    (r"\b(?:кто\s+президент|президент\s+[А-ЯA-Z])", "external_current_affairs"),
    (r"(?:\bсколько\s+будет\b.*\d|\d\s*[+*/=]\s*\d)", "external_arithmetic"),
)

ANAPHORA_PATTERN = r"\b(?:их|это|эти|этого|такое|такие|ему|ей|им)\b"
ANAPHORA_SHORT_PATTERN = r"\b(?:их|это|эти|этого|такое|такие)\b"
CONCRETE_ENTITY_PATTERN = r"\b[А-ЯA-Z]{2,}\b|\d|[а-яa-z]+-[а-яa-z]+"

# --- query normalisation ---------------------------------------------------

POLITE_PREFIX = (
    r"^(?:(?:привет|здравствуй(?:те)?|доброе\s+утро|добрый\s+(?:день|вечер))[,!]?\s*)?"
    r"(?:(?:подскажи(?:те)?|скажи(?:те)?|расскажи(?:те)?|объясни(?:те)?)[,!]?\s*)?"
    r"(?:(?:пожалуйста)[,!]?\s*)?"
)
WORK_PERMIT = "наряд-допуск"
WORK_PERMIT_SPACED = r"\bнаряд\s+допуск\b"
WORK_PERMIT_SHORT = r"\bнаряд\b"
WORK_PERMIT_CONTEXT = r"\bнаряд\b.*\b(?:опасн\w*|повышенн\w*)\b"
ISSUE_VERB = r"\bвыпис(?:ать|ывают|ывается)\b"
ISSUE_VERB_CANONICAL = "оформить"
DANGEROUS_WORK = r"\b(?:опасн\w*\s+работ\w*|работ\w*\s+опасн\w*)\b"
DANGEROUS_WORK_CANONICAL = "работы повышенной опасности"
FIRE_SIGNS = r"\b(?:огонь|огня|дым|дыма)\b"
FIRE_ACTION = r"(?:что\s+.*(?:делать|сделать)|если\s+(?:увидел|обнаружил)|увидел|обнаружил)"
FIRE_QUERY = "Что делать при обнаружении пожара признаков горения задымления?"
IGNITION = r"\bвозгоран\w*\b"
IGNITION_SUFFIX = "пожар"
COMPARISON_MARKERS = ("сравни", "разниц", "отлич", "в разных документах", "между")

# --- section and business intents ------------------------------------------

SECTION_RULES = (
    (("расскажи о компании", "информация о компании", "кто мы", "история компании",
      "деятельность компании", "ценности компании"), (43919, 43915)),
    (("отпуск", "удаленная работа", "график", "испытательный срок", "обучение сотрудник"), (43916,)),
    (("компьютер", "доступ", "техническая поддержка", "it поддержка", "оборудование"), (43917,)),
    (("новости", "события компании"), (43918,)),
    (("пожар", "требования пожарной безопасности", "меры пожарной безопасности"), (44030,)),
)
DEFAULT_SECTION_IDS = (43915, 43916, 43917, 43918, 43919, 44030)

BUSINESS_RULES = (
    (("компан", "кто мы", "история компании", "деятельность", "ценност", "принцип"),
     ("о компании", "наши цели", "устав")),
    (("отпуск", "удален", "график", "испытатель", "обучение", "сотрудник", "hr"),
     ("hr", "регламент", "политика", "удален")),
    (("пожар", "безопасност"), ("пожар", "безопасност")),
    (("поддержк", "компьютер", "доступ", "it"), ("техническая поддержка", "поддержка")),
)
OFF_TOPIC_TEXT = ("пожар", "опасн", "подряд")
OFF_TOPIC_EXEMPT = ("пожар", "безопасност")

# --- answer-shape markers ----------------------------------------------------

DEFINITION_MARKERS = ("что такое", "что означает", "определение", "термин")
ANSWERABLE_ACTION_MARKERS = (
    "что делать", "как ", "каким образом", "кто ", "кем ", "в каких случаях", "порядок",
    "действия", "срок", "сколько", "как часто", "когда",
)
DURATION_MARKERS = ("срок", "сколько", "как часто", "когда")
DURATION_PATTERN = r"\b\d+[\s-]*(?:календарн\w*\s+)?(?:дн\w*|час\w*|минут\w*|месяц\w*|год\w*)\b"
LIMIT_MARKERS = ("не реже", "не более", "не менее", "в течение")
ANSWERABLE_VERBS = (
    "необходимо", "обязан", "обязаны", "следует", "осуществляется", "производится", "оформляет",
    "оформить", "согласует", "согласован", "при обнаружении", "при возникновении",
)
CONTENTS_MARKER = "оглавление"
TERMS_MARKERS = ("термины, определения", "термины определения")
MEMBERSHIP_PATTERN = r"\bкто\s+(?:входит|состоит)\b"
MEMBERSHIP_MARKER = "состав комис"
MEMBERSHIP_TEXT = "в состав"
MEMBERSHIP_VERB = r"\bвход\w*\b"
COMPOSITION_MENTIONS = ("состав эвакуационной комиссии", "состав комиссии")
ROLE_MARKERS = ("председател", "заместител", "секретар", "член групп", "старший групп")
MEETING_MARKERS = ("задачи комиссии", "заседания", "деятельностью комиссии")
OWNER_QUERY = ("кто ", "кем ", "ответственный")
OWNER_TEXT = (
    "ответственн", "представител", "руководител", "служб", "работник", "председател", "секретар",
)

# --- sentence intent ----------------------------------------------------------

SENTENCE_WHO_QUERY = ("кто ", "кем ", "какая организация", "какое подразделение")
SENTENCE_TIME_QUERY = ("срок", "сколько", "как часто", "когда", "периодич")
SENTENCE_ACTION_QUERY = ("что делать", "как ", "каким образом", "действия", "порядок", "в каких случаях")
SENTENCE_COMPOSITION = "состав эвакуационной комиссии"
SENTENCE_TASKS = ("задачи комиссии", "проводит плановые заседания", "руководство деятельностью")
SENTENCE_ROLE_PATTERN = (
    r"\b(?:эксперт(?:ом|а|ы|ов|ами)?|работник(?:ами|и|ов|ом)?|комисси\w*|руководител\w*|"
    r"представител\w*|служб\w*|ответственн\w*)\b"
)
SENTENCE_ORG_PATTERN = r"организаци\w*[, ]+(?:осуществля|проводящ|выполняющ)\w*"
SENTENCE_WHO_VERBS = ("проводится", "проводит", "осуществля", "выполняется", "принимается")
SENTENCE_LIMITS = (
    "не реже", "не более", "не менее", "в течение", "по истечении", "ежеднев", "ежегод",
)
SENTENCE_ACTIONS = (
    "необходимо", "обязан", "обязаны", "следует", "немедленно", "незамедлительно",
    "осуществляется", "производится", "оформить", "оформляет", "согласует", "принять меры",
    "привести в действие", "эвакуац",
)
DUTIES_HEADING = "обязанности и действия"
DEFINITION_TEXT = ("документ", "состояние", "процесс", "комплекс положений")
HEADING_PATTERN = r"(?:порядок|раздел|глава|приложение)\b"

# --- context profiles ----------------------------------------------------------

MULTIPART_MARKERS = (" и ", ";", ", а ")
PROCEDURE_MARKERS = (
    "что делать", "порядок", "порядок действий", "какие действия", "действия при", "этап", "шаг",
    "как оформ", "как провод", "как выполня", "в каких случаях", "какие требования", "какие меры",
    "перечисл", "опиши",
)
FACT_MARKERS = (
    "срок", "сколько", "кто ", "кем ", "когда", "что такое", "что означает", "определение",
    "какой", "какая", "какое",
)
# profile -> (passage chars, context chars, chunks)
PROFILE_LIMITS = {"procedure": (420, 1400, 3), "fact": (340, 760, 2), "default": (380, 1100, 3)}

# --- extractive answer -----------------------------------------------------------

ACRONYM_DEFINITIONS = (
    ("соут", "специальная оценка условий труда"),
    ("сиз", "средства индивидуальной защиты"),
)
DEFINITION_QUERY = ("что такое", "что означает", "расшифр")
MEMBERSHIP_ANSWER = "В состав комиссии входят: "
PLACEHOLDER_PATTERN = r"\[(?:ОРГАНИЗАЦИЯ|ЧЕЛОВЕК|АДРЕС)_\d+\]"
EXTRACTIVE_PROCEDURE = (
    "что делать", "как ", "порядок", "действия", "как оформ", "как провод", "как выполня",
    "какие меры", "какие требования",
)

# --- relevance guard ---------------------------------------------------------------

ACRONYM_MEANINGS = (
    ("соут", "специальная оценка условий труда"),
    ("сиз", "средства индивидуальной защиты"),
)
WHO_PATTERN = r"\b(?:кто|кому|кем)\b"
WHO_MARKER = "ответствен"
TIME_QUERY = ("срок", "сколько", "как часто", "периодич", "когда")
GUARD_DEFINITION_QUERY = ("что такое", "что означает", "определение")
GUARD_PROCEDURE_QUERY = (
    "что делать", "как оформ", "как провод", "как выполня", "порядок", "какие действия",
    "какие меры", "какие требования", "в каких случаях",
)
WHO_ANSWER = (
    r"\b(?:ответствен\w*|руководител\w*|представител\w*|работник\w*|комисси\w*|служб\w*|"
    r"организаци\w*|лиц\w*|директор\w*|специалист\w*|диспетчер\w*|подрядчик\w*)\b"
)
MEMBERSHIP_ANSWER_PATTERN = (
    r"\b(?:входит\w*|состо\w*|член\w*|председател\w*|заместител\w*|секретар\w*)\b"
)
AGREEMENT_MARKER = "соглас"
NOTIFY_MARKER = "сообщ"
DEFINITION_ANSWER = (
    r"(?:—|-)\s*это\b|\bэто\b|представляет собой|определяется как|понимается как"
)
TIME_ANSWER_NUMBER = r"\b\d+(?:[.,]\d+)?\b"
TIME_ANSWER = (
    "не более", "не менее", "в течение", "ежегод", "ежеднев", "ежемесяч", "по истечении",
)
PROCEDURE_ANSWER = (
    "необходимо", "следует", "обязан", "обязаны", "оформ", "соглас", "сообщ", "провод", "выполн",
    "назнач", "провер", "обеспеч", "запрещ", "допускается", "эваку", "принять меры",
)

# --- abstention ------------------------------------------------------------------------

ABSTAIN_MARKER = "недостаточно данных"
ABSTAIN_PATTERNS = (
    r"(?:в (?:источниках|source)|источники).*?(?:нет|не содержат|недостаточно).*?информац",
    r"недостаточно (?:информации|данных).*?(?:ответ|источник)",
)

# --- messages ----------------------------------------------------------------------------

MSG_EXTERNAL = "Этот вопрос не относится к подключённой базе знаний."
MSG_CLARIFY_ANAPHORA = (
    "Уточните, пожалуйста, к какому документу, процессу или виду работ относится вопрос."
)
MSG_CLARIFY_GENERIC = (
    "Уточните, пожалуйста, объект вопроса: какой документ, процесс, вид работ или ситуация вас "
    "интересует."
)
MSG_CLARIFY_TIE = (
    "В базе найдено несколько одинаково релевантных процедур. Уточните вид работ, документ или "
    "ситуацию, к которой относится вопрос."
)
MSG_CLARIFY_REFERENCE = (
    "Уточните, пожалуйста, изменения какого документа, процесса или вида работ вы имеете в виду."
)
MSG_WEAK = (
    "В базе знаний не найдено достаточно релевантной информации для надёжного ответа на этот вопрос."
)
MSG_NOTHING_FOUND = "В базе знаний не найдено подходящих материалов."
MSG_INSUFFICIENT = "В базе знаний недостаточно информации для надёжного ответа."
MSG_SOURCES_INSUFFICIENT = "В переданных источниках недостаточно информации для надёжного ответа."
MSG_SECOND_SEARCH_EMPTY = "Повторный поиск не нашёл достаточной информации."
MSG_SECOND_SEARCH_NO_PASSAGE = "Повторный поиск не позволил выделить релевантные фрагменты."
MSG_VALIDATION = "Не удалось сформировать подтверждённый ответ."
MSG_UNAVAILABLE = "Локальная языковая модель недоступна."
MSG_GENERATION_ERROR = "Не удалось обработать запрос."

ISSUE_EMPTY = "Ответ пустой."
ISSUE_UNKNOWN_CITED = "Несуществующие ссылки в тексте: "
ISSUE_UNKNOWN_DECLARED = "Несуществующие used_source_ids: "
ISSUE_NO_CITATIONS = "Ответ не содержит ссылок [S1], [S2] и т.д."
ISSUE_MISMATCH = "Ссылки в answer не совпадают с used_source_ids."
ISSUE_URL = "Модель вставила URL самостоятельно."
SEMANTIC_NO_REASON = "Семантический валидатор отклонил ответ без объяснения."
SEMANTIC_INCOMPLETE = "Ответ не раскрывает все части вопроса."
SEMANTIC_UNGROUNDED = "Ответ не полностью подтверждён переданными источниками."
SOURCES_LINE = "Источники: "
