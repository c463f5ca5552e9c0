"""Schemas of ledger records, as DDL."""

SOURCE = "struct<label:string,session_ids:array<string>,turn_ids:array<string>,raw_spans:array<struct<source_id:string,turn_id:string,char_start:bigint,char_end:bigint>>,tool_result_ids:array<string>,artifact_ids:array<string>,quote:string>"
SCOPE = "struct<user:string,org:string,workspace:string,project:string,agent:string,session:string>"
NODE = (
    f"schema_version string, id string, type string, scope {SCOPE}, key string, content string, status string, confidence double, priority string, created_at string, updated_at string, effective_from string, effective_until string, "
    f"source {SOURCE}, relations map<string,array<string>>, retrieval struct<sparse_keys:array<string>,dense_text:string,entity_keys:array<string>,temporal_keys:array<string>>, metadata string, tags array<string>"
)
PATCH = (
    f"schema_version string, id string, operation string, target_ids array<string>, new_node_ids array<string>, reason string, new_content string, source {SOURCE}, confidence double, "
    "resolution_policy struct<rule:string,auto_applied:boolean,requires_review:boolean>, prior_states map<string,string>, created_at string, applied_at string"
)
EDGE = "schema_version string, id string, from_id string, to_id string, type string, created_at string, source_patch_id string"
