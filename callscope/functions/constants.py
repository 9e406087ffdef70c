"""The words, formats and thresholds that results depend on."""

# Verdict words of a classification, in the order they are looked for in a reply.
LABELS = ("BLOCK", "ALLOW", "REVIEW")

# Characters of the first line that stand in when a reply holds no verdict word.
LABEL_FALLBACK_CHARS = 30

# Strictness of a policy verdict; the highest applicable one wins.
SEVERITY = {"BLOCK": 3, "REVIEW": 2, "ALLOW": 1}
DEFAULT_VERDICT = "ALLOW"

# Request fields.
USER_PREFIX = "User message to classify: "
MAX_OUTPUT_TOKENS = 512
TEMPERATURE = 0.0
ISOLATED_BUCKET_PREFIX = "iso-"

# Response fields.
MESSAGE_ITEM = "message"
TEXT_PART = "output_text"
TEXT_EVENT = "response.output_text.delta"
DONE_EVENT = "response.completed"

# Cache tags.
COLD = "COLD"
WARM = "WARM"
WARM_PCT = "WARM (%d%% cached)"
WARM_FASTER = "WARM (%s× faster than cold)"
WARM_ACTIVE = "WARM (prompt_cache_key active)"
WARM_TOKENS = "WARM (%d cached tkns)"
WARM_KEY = "WARM (key active)"

# A warm call counts as faster below this share of the cold latency.
FASTER_SHARE = 0.85

# Speedup thresholds of the time-to-first-token verdict, on the unrounded ratio.
ACTIVE_FROM = 1.5
LIKELY_FROM = 1.1
ACTIVE = "CACHE ACTIVE"
LIKELY = "CACHE LIKELY ACTIVE"
NOT_CONFIRMED = "CACHE NOT CONFIRMED"

# Shortest prefix, in tokens, that a provider caches.
MIN_PREFIX_TOKENS = 1024

# Share of the price taken off cached input tokens, unless the caller says otherwise.
CACHED_DISCOUNT = "0.5"

# Preview lengths, in characters.
MESSAGE_PREVIEW = 55
LONG_PREVIEW = 120
LONG_PREVIEW_NOTE = " … [%d chars stored in full]"
ERROR_PREVIEW = 300

# What stands in for a missing role of a stored input item.
NO_ROLE = "?"

# Character classes (the text semantics of a Unicode-aware word search, strip and
# line split): word characters, white space, line ends.
WORD_CHARS = r"\p{L}\p{N}_"
SPACE_CHARS = (
    r"\t-\r\x1C-\x20\x85\xA0\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
LINE_ENDS = r"\n-\r\x1C-\x1E\x85\x{2028}\x{2029}"
