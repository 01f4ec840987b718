"""Column functions of the review operators, in one place."""

from ..operators.classify import has_test_segment, has_test_suffix, is_canonical_path, is_generated, is_test_assembly, project_role
from ..operators.findings import finding_id, project_key, short_symbol, type_id
from ..operators.fragments import encode, numbered_symbols
from ..operators.graphs import running_depth
from ..operators.identifiers import offending, snippet
from ..operators.percentiles import nearest_rank
from ..operators.similarity import ngrams, tokens
from ..operators.sizes import branchy, first_line, line_count

__all__ = [
    "branchy", "encode", "finding_id", "first_line", "has_test_segment", "has_test_suffix", "is_canonical_path", "is_generated", "is_test_assembly",
    "line_count", "nearest_rank", "ngrams", "numbered_symbols", "offending", "project_key", "project_role", "running_depth", "short_symbol", "snippet", "tokens", "type_id",
]
