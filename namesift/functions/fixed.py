"""Texts and numbers that results depend on word for word."""

# Fixed values. Answer that means "nothing found".
UNKNOWN = "Unknown"

# Fixed values. Retry budget of one model call: failed attempts, first wait in seconds.
MAX_FAILED_ATTEMPTS = 20
FIRST_WAIT_SECONDS = 1.0

# Fixed values. Messages of the open extraction prompt.
ENTITY_TASK = "Your job is to extract the {entity} being described by the text provided."
ENTITY_ONLY = "Respond ONLY with the {entity} ONLY {entity}"
ENTITY_MISSING = "If {entity} is not found, respond ONLY with Unknown ONLY Unknown"

# Fixed values. Messages of the category prompt.
CATEGORY_TASK = "Your job is to extract the category being described by the text provided."
CATEGORY_CHOICES = "You can only choose from the following categories: {categories}"
CATEGORY_ONLY = "Respond ONLY with the category ONLY category"
CATEGORY_MISSING = "If a category is not found, respond ONLY with Unknown ONLY Unknown"

# Fixed values. Messages of the first-name prompt.
NAME_TASK = "Your job is answer a yes or no question."
NAME_QUESTION = ("Is ", " the first name of ", "?")
NAME_ONLY = "Respond ONLY with Y or N, do not add a period at the end"

# Fixed values. Messages of the attribute prompt.
ATTRIBUTE_TASK = "Your job is to extract the {attribute} title of the person being described by the text provided."
ATTRIBUTE_TEXT = "text: "
ATTRIBUTE_ONLY = "Respond ONLY with the {attribute} title, and do not add a period at the end"
ATTRIBUTE_ONE = "The response should only contain ONE {attribute} title, with no period at the end."
ATTRIBUTE_MISSING = (
    "If {attribute} is not found, respond ONLY with Unknown ONLY Unknown, do not add a period at the end"
)

# Fixed values. Instruction template around one prompt.
INSTRUCTION_HEAD = (
    "Below is an instruction that describes a task. "
    "Write a response that appropriately completes the request.\n\n### Instruction:\n"
)
INSTRUCTION_TAIL = "\n\n### Response:\n"

# Fixed values. Question wrapped around one sentence.
COUNTRY_QUESTION = (
    'Extract the country names (IGNORE continents) in this sentence; '
    'respond ONLY with the country names extracted: "',
    '"',
)

# Fixed values. Question built from a film row: around the year, text before each column, end.
FILM_QUESTION_YEAR = ("What ", " movie")
FILM_QUESTION_PARTS = [
    (" was directed by ", "director"),
    (" and had actor(s) ", "actor_1"),
    (", ", "actor_2"),
    (", ", "actor_3"),
]
FILM_QUESTION_END = "? Respond with ONLY the movie's official title."

# Fixed values. Categories of a count sentence.
COUNT_CATEGORIES = [
    "total deaths",
    "new deaths",
    "total recovered",
    "new recovered",
    "total confirmed",
    "new confirmed",
]

# Fixed values. Words four and five of a templated count sentence, and the category they mean.
COUNT_TEMPLATES = {
    "new cases": "new confirmed",
    "total confirmed": "total confirmed",
    "cases in": "total confirmed",
    "confirmed cases": "total confirmed",
    "total cases": "total confirmed",
    "cases .": "total confirmed",
    "deaths cases": "total deaths",
    "recovered cases": "total recovered",
}
