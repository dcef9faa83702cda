"""Index long structured documents and answer queries over them, on Spark.

The public functions are imported on first use.
"""

_PUBLIC = {
    "api": ("benchmark", "build_index", "build_paged", "expand_sections", "index_documents", "localize_sections", "parse_query", "retrieve_candidates", "retrieve_evidence", "retrieve_tree", "section_table"),
    "config": ("Settings", "settings"),
    "operators.retrieval": ("package",),
    "operators.trees": ("compare_trees", "comparison_report"),
}
__all__ = sorted(n for names in _PUBLIC.values() for n in names)


def __getattr__(name: str):
    from importlib import import_module

    for module, names in _PUBLIC.items():
        if name in names:
            return getattr(import_module(f"leafspan.{module}"), name)
    raise AttributeError(name)
