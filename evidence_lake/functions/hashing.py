"""Digests. All of them are plain SHA-256 over text, so any tool can recompute them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def line_sha256(line: Column) -> Column:
    return F.sha2(line, 256)


def event_key(
    source: Column, host: Column, path: Column, offset: Column, sha: Column, generation: Column | None = None
) -> Column:
    """Deterministic event id: the same bytes at the same place of the same file always get the same id.

    A file that replaced another under the same path counts its generation; the first adds nothing.
    """
    place = [offset.cast("string")]
    if generation is not None:
        place.append(F.when(generation > 0, F.concat(F.lit("g"), generation.cast("string"))))
    return F.sha2(F.concat_ws("|", source, host, path, *place, sha), 256)


def _newline_terminated(items: Column) -> Column:
    return F.sha2(F.concat(F.array_join(items, "\n"), F.lit("\n")), 256)


def batch_digest(ids: Column) -> Column:
    """Order-independent id of a batch: SHA-256 over its sorted event ids, one per line."""
    return _newline_terminated(F.sort_array(ids))


def ordered_digest(placed: Column, field: str) -> Column:
    """SHA-256 over `field` of an array of structs, in the structs' own order."""
    return _newline_terminated(F.transform(F.sort_array(placed), lambda item: item[field]))
