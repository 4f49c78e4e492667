"""docweave: keep a large collection of files documented, as Spark jobs.

DataFrame in, DataFrame out. Main entry points:

* sources: ``corpus_from_table``, ``scan_directory`` (rounds of listing tasks), ``read_state_trees``
* the run: ``run`` / ``read_current_state`` (inventory -> change plan -> prompts -> enrichment -> state)
* operators: ``plan_changes``, ``merge_states``, ``apply_ignore_rules``, ``chunk_triple``,
  ``render_prompt``, ``enrich``, ``rollup_dirs``, ``nest_export``, ``list_rows``, ``tree_lines``
* streaming: ``document_stream``
"""

from .operators.chunking import chunk_triple, pack_text
from .operators.enrich import ChatCompletionsClient, DeterministicClient, enrich, finalize_records
from .operators.hierarchy import derive_nodes, nest_export, rollup_dirs, stamp_dirs
from .operators.inventory import apply_ignore_rules, compile_ignore_patterns, drop_hidden, prune_dirs
from .operators.prompt import render_prompt
from .operators.reports import list_rows, listing_nodes, tree_lines
from .operators.state import find_nested_states, load_annotations, merge_states, nearest_root, plan_changes
from .plans.run import read_current_state, run
from .sources.corpus import corpus_from_table, fingerprint
from .sources.directory import scan_directory
from .sources.state_io import read_state_trees, write_state

__all__ = [
    "apply_ignore_rules", "chunk_triple", "ChatCompletionsClient", "compile_ignore_patterns", "corpus_from_table",
    "derive_nodes", "DeterministicClient", "drop_hidden", "enrich", "finalize_records", "find_nested_states",
    "fingerprint", "list_rows", "listing_nodes", "load_annotations", "merge_states", "nearest_root", "nest_export",
    "pack_text", "plan_changes", "prune_dirs", "read_current_state", "read_state_trees", "render_prompt",
    "rollup_dirs", "run", "scan_directory", "stamp_dirs", "tree_lines", "write_state",
]
