"""Record shapes as Spark DDL."""

SCHEDULE = "array<struct<days:string,start_time:string,end_time:string>>"
SECTION = (
    "code string, title string, type string, term string, credits string, status string, "
    f"schedule {SCHEDULE}, enrolled int, capacity int, instructor string, description string, notes string, restrictions string, offered string"
)
CRAWLED = "url string, department string, school string, depth int, content_type string, text string"
CHUNK = CRAWLED + ", chunk_index int, chunk_total int"
INDEX = "id string, embedding array<float>, document string, url string, department string, content_type string, audience string"
MESSAGES = "array<struct<role:string,content:string>>"
SESSION = f"session_id string, messages {MESSAGES}, started_at timestamp, last_active timestamp"
