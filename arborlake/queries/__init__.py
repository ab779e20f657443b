from . import block_queries, catalog_queries, corpus_queries, edit_queries, file_queries, more_queries, parser_queries, stream_queries, text_queries  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
