"""Names that markup uses: pages, bindings, handlers, component tags and calls from scripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a use of a name looks like, by kind of markup.
USES = {
    "static": (r"(?i)\.xaml$", r"\{x:Static\s+(?:\w+:)?([\w.]+)\s*\}"),
    "binding": (r"(?i)\.xaml$", r"\{Binding\s+(?:Path=)?([\w.]+)"),
    "class": (r"(?i)\.xaml$", r'x:Class\s*=\s*"([\w.]+)"'),
    "handler": (r"(?i)\.xaml$", r'\b(?:Click|Loaded|Unloaded|Checked|Unchecked|SelectionChanged|TextChanged|Closing|Closed)\s*=\s*"(\w+)"'),
    "event": (r"(?i)\.razor$", r'@on\w+\s*=\s*"@?(?:\(\)\s*=>\s*)?(\w+)'),
    "member": (r"(?i)\.razor$", r"@([A-Za-z_]\w*)"),
    "component": (r"(?i)\.razor$", r"<([A-Z]\w*)"),
    "script": (r"(?i)\.js$", r"""invokeMethod(?:Async)?\s*\(\s*['"][^'"]+['"]\s*,\s*['"](\w+)['"]"""),
}
#: Words after @ that are no members.
KEYWORDS = ["page", "using", "inject", "code", "functions", "inherits", "implements", "layout", "namespace", "attribute", "if", "else", "for", "foreach", "while", "switch", "bind", "ref", "key", "typeparam"]


def uses(markup: DataFrame) -> DataFrame:
    """(file_path, kind, name): every name that a file (file_path, text) uses; the last of dotted ones."""

    def found(kind: str) -> Column:
        path, pattern = USES[kind]
        names = F.when(F.col("file_path").rlike(path), F.regexp_extract_all("text", F.lit(pattern), F.lit(1))).otherwise(F.array().cast("array<string>"))
        last = F.transform(names, lambda n: F.element_at(F.split(n, r"\."), -1))
        return F.transform(last, lambda n: F.struct(F.lit(kind).alias("kind"), n.alias("name")))

    rows = markup.select("file_path", F.explode(F.concat(*map(found, USES))).alias("u")).select("file_path", "u.kind", "u.name")
    return rows.where(~((F.col("kind") == "member") & F.col("name").isin(KEYWORDS)) & ~F.col("name").startswith("on")).distinct()
