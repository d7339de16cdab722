"""Documents of a vault: browsing, defaults, vocabulary checks, status, drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The closed vocabularies of document rows.
VOCABULARIES = {
    "status": ("active", "archived", "complete", "superseded"),
    "document_class": ("conversation", "reference-frozen", "reference-versioned", "unclassified"),
    "doc_type": ("decision", "digest", "explanation", "how-to", "reference"),
    "confidence": ("inferred", "proposed", "stated", "unjudged", "unstated", "verified"),
}
DEFAULT_STATUSES = ("active", "complete")
MAX_K = 50


def withheld(status: Column, document_class: Column) -> Column:
    """Why a document is withheld by default: archived, superseded, sources. A null class withholds nothing."""
    return F.array_compact(F.array(F.when(status == "archived", "archived"), F.when(status == "superseded", "superseded"), F.when(document_class == "conversation", "sources")))


def default_corpus(docs: DataFrame, include_archived: bool = False, include_sources: bool = False) -> DataFrame:
    """Documents that a search sees: live statuses, and no conversations unless asked for."""
    rows = docs if include_archived else docs.where(F.col("status").isin(*DEFAULT_STATUSES))
    return rows if include_sources else rows.where(~F.col("document_class").eqNullSafe("conversation"))


def browse(docs: DataFrame, vaults: list[str] | None = None, doc_type: str | None = None, include_archived: bool = False, include_sources: bool = False, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of documents in order of path; every row has the total of all matches."""
    rows = in_vaults(default_corpus(docs, include_archived, include_sources), vaults)
    rows = rows if doc_type is None else rows.where(F.col("doc_type") == doc_type)
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    page = rows.select("path", "title", "vault", "status", "doc_type").orderBy("path").offset(offset).limit(limit)
    return page.crossJoin(F.broadcast(total))  # one row


def in_vaults(docs: DataFrame, vaults: list[str] | None) -> DataFrame:
    """None: every vault; a list narrows; an empty list is an error and never widens."""
    if vaults is None:
        return docs
    if not vaults:
        raise ValueError("an empty list of vaults selects nothing; pass None for every vault")
    return docs.where(F.col("vault").isin(*vaults))


def clamp_k(k: int) -> tuple[int, list[str]]:
    """A result count within bounds, and notes on what was changed."""
    return (k, []) if 1 <= k <= MAX_K else (max(1, min(k, MAX_K)), [f"k={k} was clamped to {max(1, min(k, MAX_K))}"])


def refusals(docs: DataFrame, vocabularies: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """path, field, value of every token outside its vocabulary. Null is no token and is never refused."""
    known = vocabularies or VOCABULARIES
    bad = [F.when(F.col(f).isNotNull() & ~F.col(f).isin(*values), F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value"))) for f, values in known.items()]
    return docs.select("path", F.explode(F.array_compact(F.array(*bad))).alias("r")).select("path", "r.field", "r.value")


def vault_groups(docs: DataFrame) -> DataFrame:
    """Documents per vault with its first tier (9 if none is known)."""
    return docs.groupBy("vault").agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.min("tier"), F.lit(9)).alias("tier"))


def drift(composed: DataFrame, indexed: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """path, change: what differs between composed notes (path, checksum, perhaps readable) and the index (path, checksum).

    A composed note that could not be read is ``unreadable`` where the index has it; a null checksum can't be verified. ``by``: scopes,
    within which paths are compared.
    """
    read = F.col("readable") if "readable" in composed.columns else F.lit(True)
    a = composed.select(*by, "path", F.col("checksum").alias("now"), F.coalesce(read, F.lit(False)).alias("read"), F.lit(True).alias("in_now"))
    b = indexed.select(*by, "path", F.col("checksum").alias("then"), F.lit(True).alias("in_then"))
    change = F.when(F.col("in_then").isNull(), "added").when(F.col("in_now").isNull(), "removed").when(~F.col("read"), "unreadable").when(F.col("now").isNull() | F.col("then").isNull(), "unverifiable").when(F.col("now") != F.col("then"), "changed")
    return a.join(b, [*by, "path"], "full_outer").select(*by, "path", change.alias("change"), (F.col("in_now") & F.col("in_then") & F.col("read")).alias("checked"))


def drift_verdicts(scopes: DataFrame, composed: DataFrame, indexed: DataFrame) -> DataFrame:
    """One row per scope (scope, error): what a check of its notes says as a whole.

    ``stale``: something was added, removed or changed; ``checkable``: every indexed note could be read. The verdict reads both: moved, unchanged and
    complete, unchanged but incomplete. A scope that could not be resolved (error) is unavailable and has no figures, so it never
    reads as unchanged; one without notes is unchanged and complete. Notes of scopes that aren't listed are left out.
    """
    count = lambda what: F.count_if(F.col("change") == what).alias(what)
    figures = drift(composed, indexed, ("scope",)).groupBy("scope").agg(*[count(c) for c in ("added", "removed", "changed", "unverifiable", "unreadable")], F.count_if("checked").alias("checked"))
    known = F.col("error").isNull()
    rows = scopes.select("scope", "error").join(figures, "scope", "left")
    rows = rows.select("scope", "error", *[F.when(known, F.coalesce(c, F.lit(0))).alias(c) for c in figures.columns[1:]])
    stale, checkable = F.col("added") + F.col("removed") + F.col("changed") > 0, F.col("unreadable") == 0
    verdict = F.when(~known, "unavailable").when(stale, "moved").when(checkable, "unchanged and complete").otherwise("unchanged but incomplete")
    return rows.select("*", stale.alias("stale"), checkable.alias("checkable"), verdict.alias("verdict"))


def wipe_plans(docs: DataFrame, listings: DataFrame) -> DataFrame:
    """What a wipe of each listed workspace would take: grp, calls, documents, other, refused.

    docs: grp, path, document_class; listings: grp, location, readable, one row per place that was looked through. A plan is whole or
    absent: if any place of a workspace could not be listed, the plan has no numbers and ``refused`` says which places, in order. Paths found
    twice count once.
    """
    kind = F.col("document_class")
    counts = docs.select("grp", "path", "document_class").distinct().groupBy("grp").agg(
        F.count_if(kind == "conversation").alias("calls"), F.count_if(F.startswith(kind, F.lit("reference-"))).alias("documents"), F.count_if(~F.coalesce((kind == "conversation") | F.startswith(kind, F.lit("reference-")), F.lit(False))).alias("other")
    )
    gates = listings.groupBy("grp").agg(F.array_sort(F.collect_set(F.when(~F.coalesce("readable", F.lit(False)), F.col("location")))).alias("bad"))
    whole = F.size("bad") == 0
    plan = gates.join(counts, gates["grp"].eqNullSafe(counts["grp"]), "left").drop(counts["grp"])
    return plan.select("grp", *[F.when(whole, F.coalesce(c, F.lit(0))).alias(c) for c in ("calls", "documents", "other")], F.when(~whole, F.array_join("bad", "; ")).alias("refused"))


def reconcile(listed: DataFrame, indexed: DataFrame, unreadable: list[str] | None = None, tolerance: float = 0.01) -> DataFrame:
    """path, change (new, changed, unchanged, removed) by path and mtime; nothing is removed while a location could not be listed."""
    a, b = listed.select("path", F.col("mtime").alias("now")), indexed.select("path", F.col("mtime").alias("then"))
    gone = F.lit("kept") if unreadable else F.lit("removed")
    change = F.when(F.col("then").isNull(), "new").when(F.col("now").isNull(), gone).when(F.abs(F.col("now") - F.col("then")) >= tolerance, "changed").otherwise("unchanged")
    return a.join(b, "path", "full_outer").select("path", change.alias("change"))


def stale_stages(current: DataFrame, ledger: DataFrame) -> DataFrame:
    """path, stage to run again: no ledger row, or another hash."""
    old = ledger.select("path", "stage", F.col("hash").alias("old"))
    return current.join(old, ["path", "stage"], "left").where(~F.col("hash").eqNullSafe(F.col("old"))).select("path", "stage")


def patched(docs: DataFrame, patch: DataFrame) -> DataFrame:
    """Metadata edits (path, title, tags) by path: a null field stays, tags are united."""
    p = patch.select("path", F.col("title").alias("new_title"), F.col("tags").alias("new_tags"))
    return docs.join(p, "path", "left").select("path", F.coalesce("new_title", "title").alias("title"), F.array_sort(F.array_union("tags", F.coalesce("new_tags", F.array().cast("array<string>")))).alias("tags"))


def enriched(docs: DataFrame, digests: DataFrame) -> DataFrame:
    """Digests (path, title, summary, tags) onto documents: title and summary only where there is none, tags united."""
    d = digests.select("path", F.col("title").alias("d_title"), F.col("summary").alias("d_summary"), F.col("tags").alias("d_tags"))
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    return docs.join(d, "path", "left").select("path", F.coalesce(blank("title"), F.col("d_title"), F.lit("")).alias("title"), F.coalesce(blank("summary"), F.col("d_summary"), F.lit("")).alias("summary"), F.array_sort(F.array_union("tags", F.coalesce("d_tags", F.array().cast("array<string>")))).alias("tags"))


def expanded(docs: DataFrame, limit: int = 20_000) -> DataFrame:
    """Whole notes up to a limit, whether they were cut, and whether they changed since (null: no basis)."""
    return docs.select("path", F.left("body", F.lit(limit)).alias("text"), (F.length("body") > limit).alias("truncated"), F.when(F.col("checksum").isNotNull(), F.col("checksum") != F.md5("body")).alias("stale"))


def context_blocks(passages: DataFrame, cap: int = 8000, least: int = 400) -> DataFrame:
    """One labelled block per question (q; rank, path, vault, status, text): every passage gets max(least, cap / n) characters."""
    per_q = passages.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("rank", "path", "vault", "status", "text"))).alias("rows"))
    size = F.greatest(F.lit(least), F.floor(F.lit(cap) / F.size("rows")).cast("int"))
    cut = lambda r: F.when(F.length(r["text"]) > size, F.concat(F.left(r["text"], size), F.lit("…"))).otherwise(r["text"])
    label = lambda r: F.concat(F.lit("["), r["rank"].cast("string"), F.lit("] "), r["path"].cast("string"), F.lit(" ("), r["vault"], F.lit(", "), r["status"], F.lit(")\n"), cut(r))
    return per_q.select("q", F.array_join(F.transform("rows", label), "\n\n").alias("block"))


def casefold_contains(values: Column, wanted: str) -> Column:
    """Whole-value match in a list, whatever the case."""
    return F.array_contains(F.transform(values, lambda x: F.lower(x)), wanted.lower())


def browse_match(values: Column, wanted: str) -> Column:
    """Substring match in any value of a list, whatever the case."""
    return F.exists(values, lambda x: F.contains(F.lower(x), F.lit(wanted.lower())))
