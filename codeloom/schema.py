"""Schemas of the stored tables. Ids are deterministic row numbers within a repository."""

from __future__ import annotations

SYMBOL = "struct<name:string,kind:string,line_start:long,line_end:long,docstring:string,parent:int>"
IMPORT = "struct<level:int,target:string,line:long>"
TABLES = {
    "repositories": "id long, url_or_path string, name string, default_branch string, status string, indexed_at timestamp_ntz, github_owner string, github_repo string",
    "files": "id long, repository_id long, path string, language string, loc long, last_modified timestamp_ntz",
    "symbols": "id long, file_id long, name string, kind string, line_start long, line_end long, docstring string, parent_symbol_id long, repository_id long",
    "edges": "id long, repository_id long, source_type string, source_id long, target_type string, target_id long, target_label string, edge_type string",
    "documents": "id long, repository_id long, path string, title string, content string",
    "commits": "id long, repository_id long, hash string, author string, date timestamp_ntz, message string",
    "issues": "id long, repository_id long, number long, title string, state string, labels array<string>, url string, linked_files array<string>",
    "chat_sessions": "id long, repository_id long, created_at timestamp_ntz",
    "chat_messages": "id long, session_id long, role string, content string, created_at timestamp_ntz, tool_trace string, repository_id long",
    "file_commits": "file_id long, commit_id long, repository_id long",
    "source_lines": "file_id long, repository_id long, path string, line long, text string",
    "digests": "repository_id long, path string, digest string, scope string",
    "parsed": f"digest string, kind string, symbols array<{SYMBOL}>, imports array<{IMPORT}>",
    "resolved_imports": "repository_id long, path string, at int, target_path string, label string",
    "postings": "repository_id long, name string, path string, line long",
}
