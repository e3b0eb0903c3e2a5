"""Detection rules, entities and prices whose exact text decides the results."""

# Injection rules in order; the first that is found names the verdict.
INJECTION_RULES = (
    r"ignore\s+(all\s+)?(previous|prior|above|former)\s+instructions?",
    r"disregard\s+(all\s+)?(previous|prior|above)\s+instructions?",
    r"forget\s+(all\s+)?(previous|prior|above|your)\s+instructions?",
    r"override\s+(all\s+)?(previous|prior)?\s*instructions?",
    r"do\s+not\s+follow\s+(your\s+)?(previous\s+)?instructions?",
    r"new\s+task\s*:\s*(ignore|disregard|forget)",
    r"(reveal|show|print|output|tell\s+me|repeat)\s+(your\s+)?(system\s+prompt|instructions?|directives?)",
    r"what\s+(are|were)\s+your\s+(original\s+)?(instructions?|prompt|directives?)",
    r"output\s+(everything|all)\s+(above|before|previously)",
    r"print\s+your\s+(full\s+)?(initial\s+)?prompt",
    r"you\s+are\s+now\s+(a|an)\s+\w+",
    r"act\s+as\s+(if\s+you\s+are\s+)?(a|an)\s+\w+\s+(with\s+no|without)",
    r"pretend\s+you\s+(are|have\s+no)\s+(restrictions?|guidelines?)?",
    r"from\s+now\s+on\s+(you\s+are|act\s+as|pretend|behave)",
    r"roleplay\s+as\s+(a|an)\s+\w+\s+(with\s+no|without)",
    r"\bDAN\b",
    r"jailbreak",
    r"developer\s+mode",
    r"god\s+mode",
    r"no\s+restrictions?",
    r"bypass\s+(your\s+)?(safety|restrictions?|guidelines?|filters?)",
    r"without\s+(any\s+)?(restrictions?|filters?|guidelines?|safety)",
    r"unrestricted\s+(mode|access|AI)",
    r"----+\s*system\s*----+",
    r"\[system\]\s*:",
    r"</?system>",
    r"###\s*system",
    r"<<SYS>>",
    r"</?(human|assistant|user|instruction)>",
    r"\[INST\]",
    r"\[/INST\]",
    r"(new|updated|additional|secret)\s+instructions?\s*:",
    r"(modified|replacement)\s+(system\s+)?prompt\s*:",
    r"send\s+(all\s+)?(the\s+)?(conversation|context|data|info)\s+to",
    r"forward\s+(this|all|the)\s+(conversation\s+)?to",
    r"exfiltrate",
    r"leak\s+(the\s+)?(prompt|instructions?|data)",
)

# The last rule number of each category, in order.
RULE_CATEGORIES = (
    ("override", 6),
    ("extraction", 10),
    ("persona", 15),
    ("jailbreak", 23),
    ("delimiter", 31),
    ("indirect", 33),
    ("exfiltration", 37),
)

# Personal-data entities in order.
ENTITIES = {
    "SSN": r"\b\d{3}-\d{2}-\d{4}\b",
    "CREDIT_CARD": r"\b(?:\d{4}[-\s]?){3}\d{4}\b",
    "EMAIL": r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b",
    "PHONE_US": r"\b(?:\+1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b",
    "IBAN": r"\b[A-Z]{2}\d{2}[A-Z0-9]{4}\d{7}(?:[A-Z0-9]?){0,16}\b",
    "IP_ADDRESS": r"\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b",
    "DATE_OF_BIRTH": r"\b(?:0?[1-9]|1[0-2])[/\-](?:0?[1-9]|[12]\d|3[01])[/\-](?:19|20)\d{2}\b",
}

# Fixed value: runs that may be base64.
BASE64_RUN = r"[A-Za-z0-9+/]{20,}={0,2}"

# US dollars for a million tokens, in and out; "unknown" stands for every other model.
PRICES = {
    "gpt-4o": (2.5, 10.0),
    "gpt-4o-mini": (0.15, 0.6),
    "gpt-4-turbo": (10.0, 30.0),
    "gpt-3.5-turbo": (0.5, 1.5),
    "claude-opus-4-7": (15.0, 75.0),
    "claude-sonnet-4-6": (3.0, 15.0),
    "claude-haiku-4-5": (0.8, 4.0),
    "gemini-1.5-pro": (3.5, 10.5),
    "gemini-1.5-flash": (0.075, 0.3),
    "llama-3.1-70b": (0.88, 0.88),
    "llama-3.1-8b": (0.2, 0.2),
    "unknown": (10.0, 30.0),
}
