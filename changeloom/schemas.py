"""Schemas of the tables that the library reads and makes, in DDL. Inputs whose order decides also have ``row_no BIGINT``."""

COMMITS = "ARRAY<STRUCT<sha STRING, message STRING>>"
FILES = "ARRAY<STRUCT<filename STRING, previous_filename STRING, status STRING, additions BIGINT, deletions BIGINT, patch STRING>>"
REPOS = "full_name STRING, stargazers_count BIGINT, forks_count BIGINT, default_branch STRING, html_url STRING, description STRING, created_at STRING, pushed_at STRING, has_skill_md BOOLEAN"
REPO_METADATA = "repo_name STRING, stars BIGINT, forks BIGINT, default_branch STRING, captured_at STRING"
FORKS = "upstream STRING, owner STRING, name STRING, full_name STRING, clone_url STRING, created_at STRING, pushed_at STRING, size BIGINT, stargazers_count BIGINT, default_branch STRING"
DIFFS = f"upstream STRING, fork_owner STRING, fork_branch STRING, base STRING, prefix STRING, status STRING, fetched_at STRING, ahead_by BIGINT, behind_by BIGINT, merge_base_sha STRING, head_sha STRING, commits {COMMITS}, files {FILES}"
INDEX = "repo STRING, path STRING, head_sha STRING, frontmatter VARIANT, n_lines BIGINT, headings ARRAY<STRUCT<level INT, text STRING, line INT>>"
LABELS = "upstream STRING, fork_owner STRING, fork_branch STRING, taxonomy_version STRING, labels ARRAY<STRING>, label_assignments ARRAY<STRUCT<name STRING, confidence STRING, evidence ARRAY<STRUCT<type STRING, summary STRING, file STRING>>>>, taxonomy_updates ARRAY<STRUCT<name STRING, rationale STRING>>, uninformative_commit_messages BOOLEAN, patch_sufficiency STRING, input_context STRING, rationale STRING"
VERDICTS = "author STRING, exported_at STRING, total BIGINT, audited BIGINT, reviewed BIGINT, verdicts ARRAY<STRUCT<record STRING, upstream STRING, fork_owner STRING, set STRING, predicted_labels STRING, has_low_confidence BOOLEAN, audited BOOLEAN, verdict STRING, remove_labels ARRAY<STRING>, add_labels ARRAY<STRING>, notes STRING>>"
INSTANCES = "modification_id STRING, upstream STRING, commit_messages ARRAY<STRING>, patch STRING, labels ARRAY<STRING>"
MESSAGES = "modification_id STRING, msg ARRAY<STRING>, gt_labels ARRAY<STRING>"
PREDICTIONS = "modification_id STRING, pred_labels ARRAY<STRING>, message_what_families ARRAY<STRING>, what_expression_categories ARRAY<STRING>, why_expression_categories ARRAY<STRING>, why_intentions ARRAY<STRING>, evidence STRING"
TAXONOMY = "taxonomy_version STRING, source STRING, families ARRAY<STRUCT<name STRING, definition STRING, patterns ARRAY<STRUCT<name STRING, definition STRING, patch_evidence_required STRING, decision_rule STRING>>>>"
RULES = "category STRING, id STRING, name STRING, severity STRING, patterns ARRAY<STRING>, description STRING, allowed_domains ARRAY<STRING>"
