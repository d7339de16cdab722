"""Entities, their identity, commitments, and upkeep of a workspace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parlance.functions import columns as C
from parlance.sources.markdown import OWNER_MARKER, front, is_owned
from parlance.sources.storage import stored


def orphans(entities: DataFrame, mentions: DataFrame) -> DataFrame:
    """Entities without a mention (an anti-join, so a null mention removes none)."""
    return entities.join(mentions, entities["id"] == mentions["entity_id"], "left_anti").select("id", "name")


def commitment_rows(lines: DataFrame, line: str = "line") -> DataFrame:
    """``owner: text [done]`` lines as rows; empty ones are dropped."""
    done = F.endswith(F.col(line), F.lit(" [done]"))
    bare = F.when(done, F.expr(f"left({line}, length({line}) - 7)")).otherwise(F.col(line))
    rows = lines.withColumns({"_bare": bare, "status": F.when(done, "done").otherwise("open")}).withColumn("_at", F.locate(": ", F.col("_bare")))
    owner = F.when(F.col("_at") > 0, F.expr("left(_bare, _at - 1)")).otherwise("")
    text = F.when(F.col("_at") > 0, F.expr("substring(_bare, _at + 2)")).otherwise(F.col("_bare"))
    return rows.withColumns({"owner": owner, "text": text}).where(F.col("text") != "").select("path", "owner", "text", "status")


def open_commitments(commitments: DataFrame, grp: str | None, owner: str | None = None, limit: int = 200) -> DataFrame:
    """Open commitments of a workspace, newest first; the owner is a filter before the limit."""
    rows = commitments.where("status = 'open'")
    rows = rows if grp is None else rows.where(F.col("grp") == grp)
    rows = rows if owner is None else rows.where(F.col("owner") == owner)
    return rows.select("path", "owner", "text", "day").orderBy(F.desc("day"), "path").limit(limit)


def _forms(entities: DataFrame, aliases: DataFrame | None, *keys: str) -> DataFrame:
    """The alias index: for every normal form of a name or alias (id, alias) within the keys the first entity in the registry's order, which is the ids'."""
    forms = entities.select("id", *keys, C.norm(F.col("name")).alias("key"))
    if aliases is not None:
        forms = forms.unionByName(entities.select("id", *keys).join(aliases.select("id", C.norm(F.col("alias")).alias("key")), "id"))
    return forms.groupBy(*keys, "key").agg(F.min("id").alias("entity"))


def _merged(rows: DataFrame, verdicts: DataFrame | None) -> DataFrame:
    """Rows (entity) with ``root``: the entity after all merges (a keeps, b becomes a); null stays null."""
    if verdicts is None:
        return rows.withColumn("root", F.col("entity"))
    roots = merge_closure(verdicts.select(F.col("b").alias("id")).distinct(), verdicts).select(F.col("id").alias("entity"), "root")
    return rows.join(roots, "entity", "left").withColumn("root", F.coalesce("root", "entity"))


def resolve_owners(commitments: DataFrame, people: DataFrame, aliases: DataFrame | None = None, verdicts: DataFrame | None = None) -> DataFrame:
    """``you`` stays; a confirmed person of the workspace, met by name or alias, becomes the id that verdicts make of it; any other name stays as
    written, so nothing is allocated. Of several people the first in the registry's order counts. Null owners stay null."""
    known = _merged(_forms(people.where("confirmed and kind = 'person'"), aliases, "grp"), verdicts)
    rows = commitments.withColumn("key", C.norm(F.col("owner"))).join(known.select("grp", "key", F.col("root").cast("string").alias("person")), ["grp", "key"], "left")
    return rows.select("path", "text", F.when(F.col("owner") == "you", "you").otherwise(F.coalesce("person", "owner")).alias("owner_id"))


def mark_done(commitments: DataFrame, named: DataFrame) -> DataFrame:
    """Commitments (path, place, owner, text, status) with the named ones (path, owner, text) done: of each call's open entries of that
    owner and text the first. Others, of other calls or already done, stay; a name that nothing meets changes nothing."""
    keys = ["path", "owner", "text"]
    first = commitments.where("status = 'open'").join(named.select(*keys).distinct(), keys, "left_semi").groupBy(*keys).agg(F.min("place").alias("_first"))
    hit = (F.col("status") == "open") & (F.col("place") == F.col("_first"))
    return commitments.join(first, keys, "left").select("path", "place", "owner", "text", F.when(hit, "done").otherwise(F.col("status")).alias("status"))


def link_stubs(mentions: DataFrame, calls: DataFrame, entities: DataFrame) -> DataFrame:
    """For each workspace and entity the links to its calls, sorted."""
    pairs = mentions.select("entity_id", "path").distinct().join(calls.where("kind = 'call'").select("path", "title", "grp"), "path")
    lists = pairs.groupBy("grp", "entity_id").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set(F.concat(F.lit("[["), "title", F.lit("]]")))), "\n").alias("links"))
    return lists.join(entities, lists["entity_id"] == entities["id"]).select(lists["grp"], "id", "name", "kind", "n", "links")


#: The marks around what is ours in a stub; all else in it is its reader's.
LINKS_BEGIN, LINKS_END = "<!-- links: begin -->", "<!-- links: end -->"


def with_region(text: Column, region: Column) -> Column:
    """A text with the region between its first marks replaced; where they are missing or the wrong way round, it is put at the end."""
    b, e = F.locate(LINKS_BEGIN, text), F.locate(LINKS_END, text)
    spliced = F.concat(F.left(text, b - 1), region, F.substr(text, e + len(LINKS_END)))
    return F.when((b > 0) & (e > b), spliced).otherwise(F.concat(text, F.lit("\n\n"), region, F.lit("\n")))


def stub_files(stubs: DataFrame, files: DataFrame) -> DataFrame:
    """The files (grp, id, content, made) that a run must write for the stubs (grp, id, name, kind, links), given those that are there (grp, id, content).

    A missing file is made with its metadata; in an owned one the region between the marks is replaced and all else stays; a file
    without the owner's mark is another's and is left alone. What would be written as it is isn't written, so a second run writes nothing. A null
    content is a missing file.
    """
    region = F.concat(F.lit(LINKS_BEGIN + "\n"), F.when(F.col("links") == "", "").otherwise(F.concat(F.lit("- "), F.replace("links", F.lit("\n"), F.lit("\n- ")))), F.lit("\n" + LINKS_END))
    head = F.concat(F.lit(f"---\napp: {OWNER_MARKER}\nkind: "), "kind", F.lit('\ngroup: "'), F.coalesce("grp", F.lit("")), F.lit('"\n---\n\n# '), "name", F.lit("\n\n"), region, F.lit("\n"))
    there = files.select(F.col("grp").alias("_grp"), F.col("id").alias("_id"), F.col("content").alias("old"))
    rows = stubs.join(there, F.col("grp").eqNullSafe(F.col("_grp")) & (F.col("id") == F.col("_id")), "left")
    new = F.when(F.col("old").isNull(), head).when(is_owned(front(F.col("old"))), with_region(F.col("old"), region))
    return rows.select("grp", "id", new.alias("content"), F.col("old").isNull().alias("made"), "old").where(F.col("content").isNotNull() & ~F.col("content").eqNullSafe(F.col("old"))).drop("old")


def repair_casing(stored: DataFrame, real: DataFrame) -> DataFrame:
    """Stored spellings with the real one, where exactly one matches but for case."""
    keys = real.groupBy(F.lower("real").alias("key")).agg(F.count(F.lit(1)).alias("_k"), F.min("real").alias("real")).where("_k = 1")
    return stored.withColumn("key", F.lower("stored")).join(keys, "key").select("stored", "n", "real")


def attendee_lists(rows: DataFrame, key: str) -> DataFrame:
    """Names in order (key, ord, name, is_self): self left out, each name once whatever its case."""
    once = rows.where(~F.col("is_self")).groupBy(key, F.lower("name").alias("_k")).agg(F.min(F.struct("ord", "name")).alias("first"))
    lists = once.groupBy(key).agg(F.sort_array(F.collect_list("first")).alias("all"))
    return lists.select(key, F.array_join(F.transform("all", lambda r: r["name"]), ", ").alias("attendees"), F.size("all").alias("n"))


def retention_list(files: DataFrame, today: str, days: int) -> DataFrame:
    """Files (path, name, owned, day) to delete: the name's shape, the owner's mark, and older than max(1, days)."""
    shape = r" — \d{4}-\d{2}-\d{2} \d{4}( \(\d+\))?$"
    return files.where(F.col("name").rlike(shape) & F.col("owned") & (F.col("day") < F.date_sub(F.lit(today).cast("date"), max(1, days))))


def wipe(tables: dict[str, DataFrame], doomed: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of the doomed paths."""
    return {name: df.join(doomed, "path", "left_anti") for name, df in tables.items()}


def resolve_surfaces(surfaces: DataFrame, entities: DataFrame, aliases: DataFrame | None = None, verdicts: DataFrame | None = None) -> DataFrame:
    """Mention surfaces (surface, kind, grp) to entities by exact name or alias within the kind: entity, id, kind, aliases, grps, n.

    Of several entities the first in the registry's order takes a form. A form that none has makes one new entity for all
    its rows, with an id made of kind and form, so reruns agree. Each entity gains the forms and workspaces it was met by; ``id`` is what
    verdicts (a keeps, b becomes a) make of it. Rows without a surface are left out.
    """
    known = _forms(entities, aliases, "kind")
    forms = surfaces.where("surface is not null").groupBy("kind", C.norm(F.col("surface")).alias("key"), "grp").agg(F.count(F.lit(1)).alias("n"))
    rows = _merged(forms.join(known, ["kind", "key"], "left"), verdicts)
    made = F.substring(F.sha2(F.concat_ws("|", "kind", "key"), 256), 1, 16)
    join = lambda c: F.array_join(F.array_sort(F.collect_set(c)), "|").alias(c)
    out = rows.withColumns({"entity": F.coalesce(F.col("entity").cast("string"), made), "id": F.coalesce(F.col("root").cast("string"), made)}).withColumnRenamed("key", "aliases").withColumnRenamed("grp", "grps")
    return out.groupBy("entity", "id", "kind").agg(join("aliases"), join("grps"), F.sum("n").alias("n"))


def merge_closure(entities: DataFrame, same: DataFrame, hops: int = 64) -> DataFrame:
    """Follows verdicts (a keeps, b becomes a; the smallest a counts) to the end: id, root.

    Pointers jump, so hops double. Only ids with a verdict take part, each round is stored, and rounds end when
    nothing moves. A kept id need not be an entity itself.
    """
    at = stored(same.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("root")), "merges")
    done = 1
    while done < hops:
        step = at.select(F.col("id").alias("root"), F.col("root").alias("next"))
        moved = stored(at.join(step, "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "merges")
        at = moved.select("id", "root")
        done *= 2
        if not moved.where("moved").limit(1).count():
            break
    return entities.select("id").join(at, "id", "left").select("id", F.coalesce("root", "id").alias("root"))


def collision_pairs(entities: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Pairs of one kind and workspace where one name's words are strictly among the other's, without a verdict. Terms are no identities."""
    rows = entities.where("kind <> 'term'").select("id", "name", "kind", "grp", F.array_distinct(F.split(C.norm(F.col("name")), r"\s+")).alias("words"))
    short = rows.select(F.col("id").alias("a"), F.col("name").alias("a_name"), "kind", "grp", F.col("words").alias("a_words"), F.element_at("words", 1).alias("word"))
    long = rows.where(F.size("words") > 1).select(F.col("id").alias("b"), F.col("name").alias("b_name"), "kind", "grp", F.col("words").alias("b_words"), F.explode("words").alias("word"))
    inside = (F.size("a_words") < F.size("b_words")) & (F.size(F.array_except("a_words", "b_words")) == 0)
    pairs = short.join(long, ["kind", "grp", "word"]).where(inside).select("a", "b", "a_name", "b_name", "kind", "grp")
    known = verdicts.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))
    return pairs.join(known, (F.least("a", "b") == F.col("x")) & (F.greatest("a", "b") == F.col("y")), "left_anti")


def _by_words(entities: DataFrame) -> DataFrame:
    """The entities that are no terms, with the set of their name's words."""
    return entities.where("kind <> 'term'").withColumn("words", F.array_sort(F.array_distinct(F.split(C.norm(F.col("name")), r"\s+"))))


def name_classes(entities: DataFrame) -> DataFrame:
    """id, kind, grp, class: within a kind and workspace, names of the same words form a class, named by its smallest id. Entities without a name or
    workspace are in none, as they collide with nothing."""
    rows = _by_words(entities)
    keys = ["kind", "grp", "words"]
    return rows.join(rows.groupBy(*keys).agg(F.min("id").alias("class")), keys).select("id", "kind", "grp", "class")


def collision_classes(entities: DataFrame, verdicts: DataFrame) -> DataFrame:
    """``collision_pairs`` by classes of names (see ``name_classes``): a, b and their names stand for two classes with so many copies, every member
    of one colliding with every member of the other; ``open`` is how many of these pairs have no verdict, and is never 0.

    Rows are one per pair of different word sets, however many copies a name has.
    """
    rows = _by_words(entities)
    keys = ["kind", "grp", "words"]
    classes = rows.groupBy(*keys).agg(F.min(F.struct("id", "name")).alias("first"), F.count(F.lit(1)).alias("copies"))
    of = lambda x: classes.select("kind", "grp", F.col("first.id").alias(x), F.col("first.name").alias(f"{x}_name"), F.col("copies").alias(f"{x}_copies"), F.col("words").alias(f"{x}_words"))
    short = of("a").withColumn("word", F.element_at("a_words", 1))
    long = of("b").where(F.size("b_words") > 1).withColumn("word", F.explode("b_words"))
    inside = (F.size("a_words") < F.size("b_words")) & (F.size(F.array_except("a_words", "b_words")) == 0)
    pairs = short.join(long, ["kind", "grp", "word"]).where(inside)
    once = verdicts.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).distinct()
    member = lambda x: rows.select("kind", "grp", F.col("id").alias(x), F.col("words").alias(f"{x}_words"))
    met = once.join(member("x"), "x").join(member("y"), ["y", "kind", "grp"])
    fewer = F.size("x_words") < F.size("y_words")
    told = met.groupBy("kind", "grp", F.when(fewer, F.col("x_words")).otherwise(F.col("y_words")).alias("a_words"), F.when(fewer, F.col("y_words")).otherwise(F.col("x_words")).alias("b_words")).agg(F.count(F.lit(1)).alias("told"))
    left = F.col("a_copies") * F.col("b_copies") - F.coalesce("told", F.lit(0))
    return pairs.join(told, ["kind", "grp", "a_words", "b_words"], "left").select("a", "b", "a_name", "b_name", "kind", "grp", "a_copies", "b_copies", left.alias("open")).where("open > 0")


def first_pairs(pairs: DataFrame, limit: int = 3) -> DataFrame:
    """The first pairs of each workspace by the ids' order, with their place."""
    place = F.row_number().over(W.partitionBy("grp").orderBy(F.least("a", "b"), F.greatest("a", "b")))
    return pairs.withColumn("place", place).where(F.col("place") <= limit)


def first_collisions(entities: DataFrame, verdicts: DataFrame, limit: int = 3) -> DataFrame:
    """The first collision pairs of each workspace, as ``first_pairs`` of all of them, without making them all.

    Names of the same words form a class, whose members collide with the same others. A pair with a member before which so many members without
    any verdict come has as many pairs before it, since each of these makes an earlier one with the same partner. So only
    members up to that place are paired.
    """
    rows = entities.where("kind <> 'term'").withColumn("_class", F.array_sort(F.array_distinct(F.split(C.norm(F.col("name")), r"\s+"))))
    told = verdicts.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    keys = ["kind", "grp", "_class"]
    free = rows.join(told, "id", "left_anti").select(*keys, "id")
    early = free.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy("id"))).where(F.col("_n") <= limit)
    ends = early.where(F.col("_n") == limit).select(*keys, F.col("id").alias("_end"))
    kept = rows.join(ends, keys, "left").where(F.col("_end").isNull() | (F.col("id") <= F.col("_end"))).select(*entities.columns)
    return first_pairs(collision_pairs(kept, verdicts), limit)


def purge_registry(entities: DataFrame, verdicts: DataFrame, grp: str) -> tuple[DataFrame, DataFrame]:
    """Takes a workspace out of all entities (grps: array); those left without one go, and verdicts on them."""
    left = entities.withColumn("grps", F.array_remove("grps", grp)).where(F.size("grps") > 0)
    ids = left.select("id")
    kept = verdicts.join(ids.withColumnRenamed("id", "a"), "a", "left_semi").join(ids.withColumnRenamed("id", "b"), "b", "left_semi")
    return left, kept
