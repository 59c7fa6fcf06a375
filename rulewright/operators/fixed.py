"""Word lists, patterns and tokens that results depend on. They are stated as they are used, in order."""

#: Misspellings and their corrections, applied in this order.
MISSPELLINGS = [
    ("shouldnt", "should not"), ("cancelld", "cancelled"), ("inlucde", "include"), ("includ", "include"), ("exclued", "exclude"),
    ("wont", "will not"), ("cant", "cannot"), ("dont", "do not"), ("isnt", "is not"), ("wasnt", "was not"),
]
SHORTHAND = [("pls", "please"), ("thx", "thanks")]
#: Characters that the punctuation step turns into spaces.
PUNCTUATION = "[\"'`~@#$%^&*\\-+=|\\\\/]"

#: Personal data in masking order: pattern, marker. Text for logs is cut at LOG_LENGTH first.
MASKS = [
    (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "[EMAIL_REDACTED]"),
    (r"\b(\+?\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b", "[PHONE_REDACTED]"),
    (r"\b\d{3}-?\d{2}-?\d{4}\b", "[SSN_REDACTED]"),
    (r"\b\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b", "[CREDIT_CARD_REDACTED]"),
]
LOG_LENGTH = 200
SENSITIVE_KEYS = ["password", "secret", "token", "credential", "ssn", "social_security", "credit_card", "email", "phone", "authorization", "cookie", "session"]

KEYBOARD_ROWS = ["qwertyuiop", "asdfghjkl", "zxcvbnm"]
#: What is stripped from a token before it is judged.
EDGES = ".,;:!?\"'()[]{}%$@#/\\|*^~=+-_"
PROMO = [
    r"\bfollowers\b.{0,30}\b(buy|cheap|discount|link|now|percent|off|gain|wholesale)\b",
    r"\b(buy|gain|cheap|wholesale)\b.{0,20}\bfollowers\b",
    r"\b(cheap|buy|free)\b.{0,20}\b(likes|subscribers|views)\b",
    r"\b(click|sign up|claim)\b.{0,15}\b(now|here|link|offer)\b.{0,10}\b(free|cash|prize|gift)\b",
]
STOP_REPLIES = ["ok", "yes", "no", "thanks", "thank you", "hi", "hello"]

RULE_SIGNAL = r"\b(exclude|include|should|must|filter|count|sum|calculate)\b.{0,60}\b(order|record|transaction|invoice|revenue|subscription|ticket|report|refund|metric|column|table)\b"
REQUEST_FRAMES = [
    r"\bplease\s+(add|give|assign|create|notify|alert|show)\b",
    r"\bkindly\s+(add|give)\b",
    r"\bcan\s+we\s+get\b",
    r"\bcould\s+(you|we)\s+(add|get|provide)\b",
    r"\b(it|that)\s+would\s+be\s+(nice|helpful|great|good)\s+to\b",
    r"\bwould\s+help\s+to\b",
    r"\bplease\s+give\b.{0,40}\baccess\b",
]
ISSUE_FRAMES = [
    r"\b(is|are|reads|shows|returns|counts?|renders?|loads?|opens?|landed\s+on)\s+\w{0,4}\s*(wrong|broken|overlapping|missing|stuck|slow|incorrect|off|blank)\b",
    r"\b(seems?|looks?|appears?)\s+(to\s+be\s+)?(wrong|broken|missing|incorrect|stuck|slow|off)\b",
    r"\bkeeps?\s+\w+ing\b",
    r"\b\w+ing\s+to\s+the\s+wrong\b",
    r"\b\w+ing\s+(very\s+)?slow(ly)?\b",
    r"\bis\s+the\s+\w+\s+(count|value|number|metric)\s+(wrong|off|incorrect)\b",
]
ISSUE_ARTEFACT = r"\b(button|dashboard|email|report|timer|invoice|count|metric|page|screen|table|filter|banner|chart|notification|backlog|sla|csat|tab|widget|checkbox|window|spinner|panel|console)\b"
QUESTION_FRAMES = [
    r"\bhow\s+(should|do|does|would|is|are)\b",
    r"\bwhat\s+(does|counts\s+as|qualifies\s+as|is|defines|should)\b",
    r"\bwhy\s+(is|does|do|are|would|should)\b",
    r"\bclarify\s+whether\b",
    r"\bwhether\b",
    r"\bdoes\s+(?:[\w.]+\s+){0,4}(include|exclude|represent|count|mean|signify|track)\b",
    r"\b(is|are)\s+(?:[\w.]+\s+){0,4}(inclusive|exclusive|counted|included|billed|part\s+of|subject\s+to)\b",
    r"\bshould\s+we\s+(treat|exclude|include|count|filter|use)\b",
    r"\bwhich\s+(applies|counts|should|one|rule)\b",
    r"\bwhat\s+should\s+we\b",
]
#: Rule categories, first match wins: pattern, category, confidence.
CATEGORIES = [
    (r"\b(revenue|metric|sum|total|count|average|amount)\b", "metric_definition", 0.90),
    (r"\b(exclude|include|restrict|should|must|contribute|not contribute)\b.*\b(revenue|metric|sum|total|count|average|amount)\b", "metric_definition", 0.90),
    (r"\b(should|must|only).*\b(access|view|edit|delete)\b", "access_rule", 0.85),
    (r"\b(status|state|phase)\b.*\b(map|equals|is)\b", "mapping_rule", 0.88),
    (r"\b(exclude|filter|remove|should not|must not).*\b(order|record|transaction)\b", "filter_rule", 0.92),
    (r"\b(duplicate|missing|incomplete|null|empty|invalid)\b", "data_quality_rule", 0.85),
    (r"\b(join|link|combine|merge)\b.*\b(table|record|id)\b", "join_rule", 0.82),
    (r"\b(calculate|compute|derive)\b.*\b(from|by|using)\b", "metric_definition", 0.85),
]
QUESTION_WORDS = ["what", "how", "why", "explain", "describe", "who", "when"]

DOMAIN_KEYWORDS = {
    "ecommerce": [
        "revenue", "order", "payment", "product", "customer", "discount", "price", "cart", "checkout", "inventory", "shipping", "promotion",
        "transaction", "purchase", "sale", "billing", "receipt", "refund", "quantity", "sku", "catalog", "storefront", "merchant",
    ],
    "saas": [
        "subscription", "billing", "plan", "user", "license", "seat", "tier", "upgrade", "downgrade", "renewal", "invoice", "credit",
        "trial", "onboard", "tenant", "feature", "access", "entitlement", "churn", "retention", "usage", "quota",
    ],
    "support": [
        "ticket", "support", "issue", "problem", "bug", "error", "help", "assistance", "complaint", "resolution", "incident",
        "request", "service", "agent", "priority", "escalation", "queue", "category", "tag", "assigned", "status",
    ],
}
SENSITIVE_TERMS = ["revenue", "payment", "refund", "credit", "charge", "fraud", "pci", "pii", "ssn", "tax", "compliance"]

#: Time windows, first match wins: pattern, token; {n} and {unit} stand for what the pattern finds.
TIME_WINDOWS = [
    (r"\blast\s+(\d+)\s+days?\b", "last_{n}_days"), (r"\blast\s+(\d+)\s+weeks?\b", "last_{n}_weeks"), (r"\blast\s+(\d+)\s+months?\b", "last_{n}_months"),
    (r"\b(current|this)\s+month\b", "current_month"), (r"\b(current|this)\s+quarter\b", "current_quarter"), (r"\b(current|this)\s+week\b", "current_week"), (r"\b(current|this)\s+year\b", "current_year"),
    (r"\b(previous|last)\s+month\b", "previous_month"), (r"\b(previous|last)\s+quarter\b", "previous_quarter"), (r"\b(previous|last)\s+year\b", "previous_year"),
    (r"\bytd\b|\byear\s+to\s+date\b", "ytd"), (r"\bmtd\b|\bmonth\s+to\s+date\b", "mtd"), (r"\bqtd\b|\bquarter\s+to\s+date\b", "qtd"),
    (r"\brolling\s+(\d+)\s+(days?|weeks?|months?)\b", "rolling_{n}_{unit}"), (r"\btrailing\s+(\d+)\s+(days?|weeks?|months?)\b", "trailing_{n}_{unit}"),
    (r"\btoday\b", "today"), (r"\byesterday\b", "yesterday"),
]
#: Phrases of an operation; where several occur, the longest counts.
OPERATION_PHRASES = {
    "exclude": ["exclude", "do not include", "must not include", "does not count", "don't count", "not contribute", "excluded from", "remove", "removed from"],
    "include": ["include", "must include", "should be part of", "accounts for", "part of", "count toward", "counts toward"],
    "restrict": ["restricted to", "access should be limited to", "limited to", "only show", "restrict"],
    "replace": ["replace", "instead of", "rely on", "switch", "use", "instead"],
    "subtract": ["subtract", "net out", "deduct"],
    "add": ["add", "also account for", "add to"],
}
OPERATOR_PHRASES = {
    "equals": ["equal to", "equals"], "greater_than": ["greater than", "more than", "exceeds", "above", "over"], "less_than": ["less than", "below", "under"],
    "not_equals": ["does not equal", "doesn't equal", "not equal"], "is_not_null": ["is present", "has a value", "non-empty"],
}
SCOPES = [(r"\b(global|all|entire|full)\b", "global"), (r"\b(regional?|region)\b", "regional"), (r"\b(depart|team)\b", "departmental"), (r"\b(user|customer|account)\b", "user-specific")]

# fixed values of tagged words: adjectives that are no term, nouns that stand for a table, words that are no noun, modal verbs, words that are no
# value, phrases of operations, what a text says of an operation, synonyms of tables and the columns that hold their state
ADJECTIVES = [
    "cancelled", "canceled", "completed", "returned", "refunded", "successful", "failed", "pending", "premium", "active", "inactive", "processing", "computing", "calculating",
    "include", "exclude", "total", "average", "net", "gross", "some", "all", "only", "each", "every", "other",
]
TERM_SYNONYMS = ["purchases", "transactions", "completed_order", "cancelled_order", "refund", "sale", "sales", "metric", "metrics", "clv", "ltv"]
STOP_WORDS = (
    "the a an is are was were be been have has had do does did will would could should may might can shall must not no nor but or and for in on at to by of with from that this these those it its they them their "
    "we our you your i my me when where if then than only also just very so too much many some all each every both few more most other such what which who whom how about above after before between under over up "
    "down out off through into since during while because although revenue sales order amount value count"
).split()
MODALS = ["should", "must", "will", "would", "can", "could", "may", "might", "shall", "ought", "need", "do", "does", "did", "wants", "want", "to"]
NO_VALUES = ["with", "and", "or", "for", "all", "globally", "each", "every", "the", "a", "an", "to", "from", "by", "on", "in", "at", "of", "use", "using", "should", "must", "can", "will", "would", "could"]
TAGGED_OPERATIONS = {
    "exclude": ["exclude", "must not include", "does not count", "don't count", "not contribute", "excluded from", "remove", "removed from", "excluded", "not include", "not count", "doesn't count", "never include", "should not", "should be excluded"],
    "include": ["include", "must include", "should be part of", "accounts for", "part of", "count toward", "not exclude", "not excluded", "should be included"],
    "restrict": ["restricted to", "access should be limited to", "limited to", "only show", "restrict"],
    "replace": ["replace", "instead of", "rely on", "switch", "use", "instead"],
    "subtract": ["subtract", "net out", "deduct"],
    "add": ["add", "also account for", "add to"],
}
SAYS_EXCLUDE = r"\b(?:do not consider|ignore|exclude|leave out|not include|shouldn'?t|should not|must not|can'?t|won'?t|do not count|don'?t count|not count|remove|removed from|drop|drops|strip|leave behind)\b"
SAYS_INCLUDE = r"\b(?:only .+ should(?:\s+\w+){0,3} (?:contribute|count|be included)|must include|should be part of|include|count toward|contribute to|account for|should include)\b"
TABLE_SYNONYMS = {"purchases": "orders", "transactions": "payments", "completed_order": "orders", "completed_order_items": "order_items"}
STATE_COLUMNS = {"orders": "status", "refunds": "status", "payments": "status", "tickets": "is_internal", "customers": "is_internal", "organizations": "status", "subscriptions": "cancel_at_period_end"}

# fixed values of what a text implies: states of tables by adjective (the first that fits the noun), times, date columns by preference, synonyms
STATES = [
    ("cancelled", "orders", "status", "cancelled"), ("canceled", "orders", "status", "cancelled"), ("completed", "orders", "status", "completed"), ("pending", "orders", "status", "pending"), ("refunded", "orders", "status", "refunded"), ("refunded", "refunds", "status", "refunded"),
    ("successful", "payments", "status", "successful"), ("failed", "payments", "status", "failed"), ("processing", "payments", "status", "processing"), ("active", "products", "is_active", "true"), ("inactive", "products", "is_active", "false"), ("returned", "products", "is_active", "false"),
]
TIMES = [
    (r"\bcurrent\s+month\b", "current_month"), (r"\bprevious\s+month\b", "previous_month"), (r"\bcurrent\s+quarter\b", "current_quarter"), (r"\bcurrent\s+year\b", "current_year"),
    (r"\blast\s+\d+\s+days?\b", "last_{n}_days"), (r"\blast\s+\d+\s+weeks?\b", "last_{n}_weeks"), (r"\blast\s+\d+\s+months?\b", "last_{n}_months"),
]
DATE_COLUMNS = ["created_at", "order_date", "completed_at", "paid_at", "refund_date", "transaction_date", "date"]
NOUN_SYNONYMS = {"purchases": "orders", "transactions": "payments", "completed_order": "orders", "cancelled_order": "orders", "refund": "refunds"}

# fixed values: how people put a rule, and how they do in two languages at once
CONVERSATIONAL = ["Can we make sure {rule}?", "I think {rule}.", "Please ensure that {rule}.", "We need to {rule}.", "It would be great if {rule}.", "Can you please {rule}?", "Hey, can we {rule}?", "I was wondering if we could {rule}."]
CODE_MIXED = {
    "exclude": ["{term} mein {condition} include mat karo.", "{term} mein {condition} include mat karo yaar.", "{term} se {condition} hatao.", "{condition} ko {term} calculation se nikaal do.", "Please {term} mein {condition} ko count mat karo."],
    "include": ["{term} mein {condition} bhi add karo.", "{condition} ko bhi {term} mein count karo.", "{term} calculation mein {condition} include karna zaroori hai."],
    "other": ["{term} ka {condition} wala part thoda fix karo.", "Yaar {term} mein {condition} sahi se handle karo.", "{term} logic mein {condition} ke liye ek check add karo."],
}


def title(column: str) -> str:
    """Words of a name, with underscores as blanks, each with a capital."""
    return f"JOINED⟦MAP⟦KEEP⟦split(replace({column}, '_', ' '), ' ')¦w¦w <> ''⟧¦w¦concat(upper(substring(w, 1, 1)), lower(substring(w, 2, 1000)))⟧¦' '⟧"


def sql(text: str) -> str:
    """A SQL literal."""
    return "'" + text.replace("'", "''") + "'"


def any_of(column: str, patterns: list[str]) -> str:
    return "(" + " OR ".join(f"RLIKE({column}, {sql(p)})" for p in patterns) + ")"


def values(rows: list[tuple], columns: str, name: str = "v") -> str:
    """Rows of texts and numbers as a table."""
    cell = lambda x: sql(x) if isinstance(x, str) else f"CAST({x} AS DOUBLE)" if isinstance(x, float) else str(x)
    return "(VALUES " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) + f") AS {name}({columns})"
