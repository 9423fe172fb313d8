"""Table schemas of the data model."""

ATOMS = "id string, type string, content string, aliases array<string>, weight double, created_at timestamp, seq long"
VECTORS = "atom_id string, version long, vec array<float>"
QUERIES = "query_id string, text string"
FEEDBACK = "query string, query_key string, atom_id string, signal string, delta double, created_at timestamp, seq long"
LEDGER = (
    "scope string, seq long, event_id string, kind string, task string, execution string, attempt string, revision int, "
    "supersedes string, occurred_at timestamp, recorded_at timestamp, payload string"
)
STAGES = (
    "execution string, attempt string, stage string, provider string, model string, started_at timestamp, ended_at timestamp, "
    "usage array<struct<kind:string,value:bigint,provenance:string,source:string>>"
)
PRICES = "id string, provider string, model string, currency string, effective_date date, kind string, price decimal(38,18), unit_size bigint, included_in string"
SPEECH = "sample_id string, path string, transcript string, speaker string, condition string, task_type string, language string, source string"
