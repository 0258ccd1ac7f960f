"""Vocabularies and limits of the work-item data model.

Fixed values: stored rows carry these exact texts and numbers.
"""

# Sync side.
EXECUTION_STATES = ("queued", "syncing", "completed", "failed")
SYNC_RESULTS = ("done", "unchanged", "skipped", "failed")
LIFECYCLE_STATES = (
    "active",
    "completed_retained",
    "purge_pending",
    "storage_deleting",
    "database_cleaning",
    "expired",
    "excluded",
    "paused",
)
SYNC_JOB_STATUSES = (
    "pending",
    "scheduled",
    "running",
    "retry_wait",
    "completed",
    "skipped",
    "failed",
    "cancelled",
)
ACTIVE_SYNC_JOB_STATUSES = ("pending", "scheduled", "running", "retry_wait")
PURGE_ELIGIBLE_STATES = (
    "completed_retained",
    "purge_pending",
    "storage_deleting",
    "database_cleaning",
)

# Design side.
DESIGN_ITEM_STATES = (
    "waiting_for_name",
    "waiting_for_email",
    "scheduled",
    "processing",
    "analyzed",
    "publishing",
    "ready_for_review",
    "ineligible",
    "failed",
)
DESIGN_JOB_STATUSES = ("scheduled", "running", "retry_wait", "completed", "failed", "cancelled")
ACTIVE_DESIGN_JOB_STATUSES = ("scheduled", "running", "retry_wait")
DESIGN_STAGES = (
    "waiting_for_name",
    "waiting_for_email",
    "extracting",
    "matching",
    "rendering",
    "writing_columns",
    "uploading_ai_data",
    "uploading_ai_data_pdf",
    "uploading_match_report",
)
READINESS_STAGES = ("waiting_for_name", "waiting_for_email")
EXECUTION_KINDS = ("analysis", "publication")
ARTIFACT_KINDS = ("ai_data", "ai_data_pdf", "match_report")
ARTIFACT_STATUSES = (
    "rendered",
    "uploading",
    "published",
    "superseded",
    "delete_pending",
    "deleted",
    "failed",
)
DISPATCH_CONSUMERS = ("auto_sync", "design_processing")
DISPATCH_STATUSES = ("pending", "processing", "succeeded", "failed")
DISPATCH_OUTCOMES = ("queued", "coalesced", "excluded", "ignored", "disabled")

# Change-event vocabulary.
CREATE_EVENT_TYPES = ("create_item", "create_pulse")
MOVE_EVENT_TYPES = (
    "change_group",
    "move_item_to_group",
    "move_pulse_into_group",
    "move_pulse_to_group",
)
NAME_EVENT_TYPES = ("change_name", "change_item_name", "change_pulse_name")
EVENT_ALIASES = {
    "board_id": ("boardId", "board_id", "pulseBoardId", "pulse_board_id"),
    "item_id": ("itemId", "item_id", "pulseId", "pulse_id"),
    "trigger_uuid": ("triggerUuid", "trigger_uuid"),
    "event_id": ("eventId", "event_id", "id"),
    "subscription_id": (
        "subscriptionId",
        "subscription_id",
        "webhookId",
        "webhook_id",
        "appWebhookId",
        "app_webhook_id",
    ),
    "event_type": ("type", "eventType", "event_type", "event"),
    "column_id": ("columnId", "column_id"),
    "group_id": (
        "groupId",
        "group_id",
        "destGroupId",
        "dest_group_id",
        "destinationGroupId",
        "destination_group_id",
        "newGroupId",
        "new_group_id",
    ),
}

# Text and retrieval limits.
CHUNK_SIZE = 1000
CHUNK_OVERLAP = 150
INGEST_MAX_CHARS = 400_000
INGEST_MAX_CHUNKS = 400
CANDIDATES_PER_QUERY = 8
MAX_EVIDENCE = 12
MAX_PER_FILE = 3
MAX_QUERIES = 2
MAX_COMPOUND_QUERIES = 3
MAX_CITATIONS = 6
HISTORY_LIMIT = 8
VECTOR_SIZE = 1536

# Sizes and times.
MAX_OBJECT_BYTES = 50_000_000
MAX_PDF_BYTES = 30 * 1024 * 1024
MAX_EMAIL_BYTES = 20 * 1024 * 1024
MAX_IMAGE_BYTES = 10 * 1024 * 1024
MAX_BATCH_PDF_BYTES = 100 * 1024 * 1024
ATTACHMENTS_PER_KIND = 8
DEBOUNCE_SECONDS = 90
RETENTION_DAYS = 30
LEASE_SECONDS = 3600
EVENT_LEASE_SECONDS = 300
READINESS_ALERT_SECONDS = 21_600
READINESS_INITIAL_SECONDS = 30
READINESS_MAX_SECONDS = 3600

# Column titles whose values enter the column text document.
COLUMN_TEXT_TITLES = (
    "Priority",
    "Designer",
    "Time tracking",
    "Status",
    "Date Received",
    "Hour Received",
    "New Enq / Amend",
    "TP Ref",
    "Project Name",
    "Zip Code",
    "Date Completed",
    "Hour Completed",
    "Turn Around (Hours)",
    "Date Sort",
)
PROJECT_TITLES = ("Project", "Monday Project", "Project Number", "Project No", "Project Ref")

# Canonical parameters of an enquiry, in report order.
CANONICAL_PARAMETERS = (
    "Email Subject",
    "Post Code",
    "Drawing Title",
    "Drawing Reference",
    "Revision",
    "Date Received",
    "Hour Received",
    "Company",
    "Contact",
    "Reason for Change",
    "Surveyor",
    "Target U-Value",
    "Target Min U-Value",
    "Fall of Tapered",
    "Tapered Insulation",
    "Decking",
    "Scale",
    "Page Size",
    "Bauder Contract Number",
    "Membrane",
    "VCL",
)
REASON_FOR_CHANGE = "Reviewer decision required"

# Product names by insulation category; the first hit in this order wins.
INSULATION_CATEGORIES = (
    (
        "TissueFaced PIR",
        (
            "TT47",
            "TR27",
            "Glass Tissue PIR",
            "Powerdeck F",
            "Adhered",
            "MG",
            "TR/MG",
            "FR/MG",
            "BauderPIR FA-TE",
            "PU 25W",
            "Evatherm A",
            "Hytherm ADH",
        ),
    ),
    (
        "TorchOn PIR",
        (
            "TT44",
            "TR24",
            "Torched",
            "Powerdeck U",
            "Torched",
            "BGM",
            "TR/BGM",
            "FR/BGM",
            "BauderPIR FA",
        ),
    ),
    (
        "FoilFaced PIR",
        (
            "TT46",
            "TR26",
            "Foil",
            "Powerdeck Eurodeck",
            "Mech Fixed",
            "ALU",
            "TR/ALU",
            "FR/ALU",
            "Aluminium Faced",
        ),
    ),
    (
        "ROCKWOOL HardRock MultiFix DD",
        ("Mineral wool", "Hardrock", "stonewool", "stone wool", "rock wool", "bauderrock"),
    ),
    ("Foamglas T3+", ("Cellular Glass", "foamed glass", "Bauderglas")),
    ("EPS", ("Expanded Polystrene",)),
    ("XPS", ("Extruded Polystyrene",)),
)

# Words that carry no meaning in a project name.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "been", "by", "for",
    "from", "has", "he", "in", "is", "it", "its", "of", "on", "that",
    "the", "to", "was", "were", "will", "with", "this", "but", "they",
    "have", "had", "what", "said", "each", "which", "she", "do", "how",
    "their", "if", "up", "out", "many", "then", "them", "these", "so",
    "some", "her", "would", "make", "like", "into", "him", "time", "two",
    "more", "go", "no", "way", "could", "my", "than", "call", "who",
    "sit", "now", "find", "down", "day", "did", "get", "come", "made",
    "may", "part",
)
SHORT_WORDS_KEPT = ("OF", "ST", "DR", "RD")
POSTCODE_TOKENS = (
    "[A-Z][0-9]{1,2}",
    "[A-Z][A-HJKPSTUW][0-9]{1,2}",
    "[A-Z][0-9][A-Z]",
    "[A-Z][A-HJKPSTUW][0-9][A-Z]",
    "[0-9][A-Z]{2}",
    "0[A-Z]{2}",
)
PROJECT_START_DATE = "2021-01-01"
SIMILARITY_THRESHOLD = 0.55
HIT_COUNT_CAP = 50
UNKNOWN_HIT_COUNT = 1_000_000

# Phrases that open a mail disclaimer.
DISCLAIMER_PATTERNS = (
    r"^\s*(?:disclaimer|confidentiality notice)\s*:?\s*$",
    r"^\s*the information contained in this (?:communication|e-?mail)",
    r"^\s*this (?:e-?mail|message) and any attachments",
)

# Texts of the retrieval answer when no synthesis is available.
FALLBACK_OPENING = "The model did not produce a final synthesis."
FALLBACK_PARTIAL = (
    "This is a partial project-wide review based on the available project "
    "evidence; other relevant records may not be represented."
)
FALLBACK_NOTHING = "No usable task context or document evidence was available."

# Warnings of the publication plan.
WARN_DATE = "Date Received was not written because it is missing or invalid"
WARN_HOUR = "Hour Received was not written because it is missing or invalid"
WARN_ZIP = "Zip Code was not written because it is missing or unmapped"

# Board columns read or owned by the design processing.
EMAIL_COLUMN = "file_mkpbm883"
AI_DATA_COLUMN = "file_mkza7y37"
MATCH_REPORT_COLUMN = "file_mm59rntf"
DATE_COLUMN = "date_mkpb23av"
HOUR_COLUMN = "hour_mkpbb3j1"
ZIP_COLUMN = "dropdown_mkpbafca"
OUTPUT_COLUMNS = (AI_DATA_COLUMN, MATCH_REPORT_COLUMN)
OWNED_COLUMNS = (DATE_COLUMN, HOUR_COLUMN, ZIP_COLUMN)
REQUIRED_ARTIFACTS = (
    ("ai_data", AI_DATA_COLUMN),
    ("ai_data_pdf", AI_DATA_COLUMN),
    ("match_report", MATCH_REPORT_COLUMN),
)

# File name endings.
EMAIL_ENDINGS = (".eml", ".msg")
IMAGE_ENDINGS = (".jpg", ".jpeg", ".png", ".webp")
PLACEHOLDER_IMAGE_ENDINGS = (".gif", ".bmp")
INLINE_IMAGE_ENDINGS = (".jpg", ".jpeg", ".png", ".gif", ".bmp")
EVENT_LOG_PREFIX = "design_processing_event="

# Stored texts that carry the source system's name.
SOURCE_ROOT = "monday"
COLUMNS_KIND = "monday_columns"
COLUMNS_SECTION = "monday:columns"
COLUMNS_FILENAME = "monday_columns.txt"
OVERSIZE_DETAIL = "Monday reported asset size %d bytes exceeds the configured storage limit of %d bytes"
