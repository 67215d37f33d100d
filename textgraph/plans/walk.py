"""Walks over a corpus's history: a driver loop over commits, each step a pure function of the head tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import first_parent_chain
from ..operators.history import differing, not_archived, stamped_as_superseded, tombstones_for
from ..schema import VERSIONED
from ..storage import Catalog, written

Step = Callable[[str, dict[str, DataFrame]], dict[str, DataFrame | tuple[DataFrame, DataFrame]]]


def last_commits(commits: DataFrame, head: str, back: int | None = None, since: str | None = None) -> list[str]:
    """The commits of the first-parent chain to head, oldest first: the last `back` (1 at least), or those after `since`."""
    if back is not None and back < 1:
        raise ValueError("back is 1 at least")
    chain = first_parent_chain(commits, head)
    if since is not None:
        at = chain.filter(F.col("id") == since).select("position").first()
        chain = chain.filter(F.col("position") > (at[0] if at else -1))
    rows = [r["id"] for r in chain.orderBy("position").collect()]  # a chain of names, walked one by one anyway
    return rows[-back:] if back else rows


def forward(catalog: Catalog, corpus: str, commits: list[str], step: Step, kinds: tuple[str, ...] = ("chunks", "entities")) -> int:
    """Runs step at each commit, oldest first: what changed is archived, what went is buried, all in one version a commit.

    A step gives whole tables, or (rows, keys that go) of each. Either way a commit writes what changed, and nothing else:
    deltas of the heads, and new rows of history and tombstones. Another writer's change in between is a Conflict.
    """
    version = catalog.version()
    for sha in commits:
        work = catalog.reading()
        before = {n: work.table(n) for n in VERSIONED}
        changed, appended = {}, {}
        graves = work.table("tombstones")
        for name, made in step(sha, before).items():
            keys, old = VERSIONED[name], before[name].filter(F.col("corpus_id") == corpus)
            if isinstance(made, tuple):
                rows, gone = made
                gone = old.join(gone.select(*keys), keys, "left_semi").select(*old.columns)
            else:
                rows, gone = differing(old, made.filter(F.col("corpus_id") == corpus), keys), old.join(made.select(*keys), keys, "left_anti").select(*old.columns)
            rows, gone = written(rows, f"walk-{name}"), written(gone, f"walk-gone-{name}")
            replaced = old.join(rows.select(*keys, F.col("derived_at_sha").alias("new_sha")), keys).filter(~F.col("derived_at_sha").eqNullSafe(F.col("new_sha"))).select(*old.columns)
            past = stamped_as_superseded(gone.unionByName(replaced), sha)
            appended[f"{name}_history"] = not_archived(work.table(f"{name}_history"), past, [*keys, "derived_at_kind", "derived_at_sha"])
            changed[name] = (rows, gone)
            if name in kinds:
                buried = tombstones_for(gone, rows, name.removesuffix("s").replace("entitie", "entity"), sha)
                columns = {c: F.lit(None).cast("string") for c in graves.columns if c not in buried.columns}
                own = not_archived(graves, buried.withColumns(columns), ["corpus_id", "artifact_kind", "artifact_id", "derived_at_kind", "derived_at_sha"]).select(*graves.columns)
                appended["tombstones"] = appended["tombstones"].unionByName(own) if "tombstones" in appended else own
        version = work.commit(changed=changed, appended=appended)
    return version


def backward(catalog: Catalog, corpus: str, commits: list[str], step: Callable[[str], dict[str, DataFrame]]) -> int:
    """Fills history from the newest commit to the oldest, from the corpus's cursor on; each row is superseded by the next newer commit that is known. A commit appends its own rows alone."""
    row = catalog.table("corpora").filter(F.col("id") == corpus).select("backfill_cursor").first()
    newest = list(reversed(commits))
    if row and row[0] in newest:
        newest = newest[newest.index(row[0]) + 1 :]
    version, newer = catalog.version(), row[0] if row else None
    for sha in newest:
        work, appended = catalog.reading(), {}
        for name, df in step(sha).items():
            rows = stamped_as_superseded(df, newer or sha)
            appended[f"{name}_history"] = not_archived(work.table(f"{name}_history"), rows, [*VERSIONED[name], "derived_at_kind", "derived_at_sha"])
        corpora = work.table("corpora")
        cursor = corpora.withColumn("backfill_cursor", F.when(F.col("id") == corpus, sha).otherwise(F.col("backfill_cursor")))
        version, newer = work.commit(appended=appended, replaced={"corpora": cursor}), sha
    return version
