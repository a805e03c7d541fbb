"""Table schemas and the fixed values that results depend on."""

from pyspark.sql import types as T

# Header names of a contact file, and our names for them.
CONTACT_HEADERS = {
    "Person Linkedin Url": "profile_url",
    "Email": "email",
    "First Name": "first_name",
    "Last Name": "last_name",
    "Company": "company",
}
REQUIRED_HEADERS = ("Person Linkedin Url",)

# Cell spellings that mean "missing" in a contact file.
NA_TOKENS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)

# Run and message states with the messages stored beside them.
RUNNING = "Running"
COMPLETED = "Completed"
FAILED = "Failed"
INTERRUPTED = "Interrupted"
ERROR = "Error"
SENT = "Sent"
READY = "Ready"
SKIPPED = "Skipped"
NOT_ATTEMPTED = "Not attempted"

MISSING_COLUMNS = "Missing required columns."
NO_PROFILE_ID = "Profile ID extraction failed."
USER_SKIPPED = "User skipped sending."
UNRECOGNIZED_KEY = "Unrecognized key press."
REVIEW_TIMEOUT = "Timeout waiting for user input."
SEND_DISABLED = "Send button disabled."
RUN_COMPLETED = "Run completed successfully."
RUN_INTERRUPTED = "Run was interrupted by the user (KeyboardInterrupt)."
RUN_ENDED = "Run ended unexpectedly."
RUN_UNEXPECTED_PREFIX = "An unexpected error occurred: "
RUN_STARTUP_PREFIX = "ChromeDriver Initialization Error: "

# Quota, review and send-window defaults.
DAILY_LIMIT_KEY = "daily_limit"
DEFAULT_DAILY_LIMIT = 100
REVIEW_SECONDS = 300
SEND_ZONE = "CET"
SEND_HOUR = 5
CHUNK_CHARS = 20
PREVIEW_CHARS = 100

# Markers looked for in page and composer text, and the link built from an id.
ID_MARKER = "identityDashProfilesByMemberIdentity"
INMAIL_PHRASE = "Send immediately via InMail"
EMAIL_PHRASE = "Send immediately via Email"
PROFILE_LINK_PREFIX = "https://www.linkedin.com/talent/profile/"

CONTACTS = T.StructType(
    [
        T.StructField("row_pos", T.LongType()),
        T.StructField("profile_url", T.StringType()),
        T.StructField("email", T.StringType()),
        T.StructField("first_name", T.StringType()),
        T.StructField("last_name", T.StringType()),
        T.StructField("company", T.StringType()),
    ]
)

PAGES = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("html", T.StringType()),
    ]
)

# All log times are wall-clock UTC without a zone, so no session zone can shift them.
RUNS_LOG = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("file_name", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("error_message", T.StringType()),
    ]
)

MESSAGES_LOG = T.StructType(
    [
        T.StructField("message_id", T.StringType()),
        T.StructField("run_id", T.StringType()),
        T.StructField("profile_url", T.StringType()),
        T.StructField("body", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("error_message", T.StringType()),
        T.StructField("ts", T.TimestampNTZType()),
    ]
)

SETTINGS_LOG = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("seq", T.LongType()),
    ]
)

DECISIONS = T.StructType(
    [
        T.StructField("message_id", T.StringType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("key", T.StringType()),
    ]
)

CHAT = T.ArrayType(
    T.StructType(
        [
            T.StructField("role", T.StringType()),
            T.StructField("content", T.StringType()),
        ]
    )
)

TABLES = {
    "runs_log": RUNS_LOG,
    "messages_log": MESSAGES_LOG,
    "settings_log": SETTINGS_LOG,
}
