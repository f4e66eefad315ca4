"""Normal forms of paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_path(path: Column, base: Column | None = None, fold_case: bool = False) -> Column:
    """``path`` without ``.``, ``..``, repeated and final slashes; relative ones start at ``base``.

    ``..`` at a root stays there; at the begin of a relative path without a base it is kept. Two slashes at the begin, and no more, stay two. Nothing
    left is ``.``. ``fold_case`` makes names comparable where files' case does not count: lower case, and backslashes are slashes.
    """
    whole = F.translate(F.lower(path), "\\", "/") if fold_case else path
    if base is not None:
        start = F.translate(F.lower(base), "\\", "/") if fold_case else base
        whole = F.when(F.startswith(whole, F.lit("/")), whole).otherwise(F.concat(start, F.lit("/"), whole))
    absolute = F.startswith(whole, F.lit("/"))
    root = F.when(F.rlike(whole, F.lit("^//(?!/)")), "//").when(absolute, "/").otherwise("")
    none = F.array().cast("array<string>")

    def step(done: Column, part: Column) -> Column:
        up = F.when((F.size(done) > 0) & (F.element_at(done, -1) != ".."), F.slice(done, 1, F.size(done) - 1)).when(absolute, done)
        return F.when(part.isin("", "."), done).when(part != "..", F.concat(done, F.array(part))).otherwise(F.coalesce(up, F.concat(done, F.array(part))))

    parts = F.split(whole, "/")
    joined = F.concat(root, F.array_join(F.aggregate(parts, none, step), "/"))
    return F.when(joined == "", ".").otherwise(joined)
