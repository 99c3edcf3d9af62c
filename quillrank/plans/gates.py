"""What may be shown, and why: routing, eligibility, overlap rejection, audit verdicts, digests, explanations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillrank.functions.catalog import safe_cover, work_key
from quillrank.functions.text import blank_to, isbn13, plain_part
from quillrank.operators.joins import greedy_rounds, without_known
from quillrank.operators.windows import first_per, placed

# Which states a list shows, and what a catalogue match must reach.
DECISIONS, OTHERS = ("rejected", "maybe_later"), ("saved", "imported", "new")
MATCH = (("quality", 0.82), ("title_match", 0.82), ("author_match", 0.65))


def routed(items: DataFrame, view: str | None = None, head: int | None = None) -> DataFrame:
    """Items of a view with their ``position``. items: id, status, score.

    "decisions" shows rejections and deferrals, a state's name that state, "all" or nothing
    every other state with recommended ones first. ``head`` keeps that many recommended
    ones and adds the other open states behind them, all of them.
    """
    first = (F.col("status") != "recommended").cast("int")
    order = [first, -F.col("score"), -F.col("id")]
    if head is not None and view is None:
        top = items.where("status = 'recommended'").orderBy(F.col("score").desc(), F.col("id").desc()).limit(head)
        shown = top.unionByName(items.where(F.col("status").isin(*OTHERS)))
    elif view == "decisions":
        shown = items.where(F.col("status").isin(*DECISIONS))
    elif not view or view == "all":
        shown = items.where(~F.col("status").isin(*DECISIONS))
    else:
        shown = items.where(F.col("status") == view)
    return placed(shown, order, "position")


def searched(items: DataFrame, text: str = "", genre: str = "", rated: str = "all", source: str = "", least_score: float | None = None) -> DataFrame:
    """Rows by a piece of text in title, author or genres (any case), a genre, whether rated, a source, and a least served score. items: title, author, genres, rating, source, score."""
    whole = F.lower(F.concat_ws(" ", "title", "author", F.array_join(F.coalesce("genres", F.array().cast("array<string>")), " ")))
    out = items.where(F.contains(whole, F.lit(text.strip().lower()))) if text.strip() else items
    out = out.where(F.array_contains("genres", genre)) if genre else out
    out = {"rated": out.where("rating is not null"), "unrated": out.where("rating is null")}.get(rated, out)
    out = out.where(F.col("source") == source) if source else out
    held = F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.coalesce("score", F.lit(0.0))))
    return out if least_score is None else out.where(held >= least_score)


def eligibility(works: DataFrame, reads: DataFrame, cutoff: Column) -> DataFrame:
    """(id, reason): the first gate a retrieved work fails, or 'eligible'.

    works: id, identity_conflict, work, released (date), year, url, flags, keys; reads: keys.
    A year alone is judged by year; the cutoff's own year is let pass.
    """
    late = F.coalesce(F.col("released") > cutoff, F.col("year") > F.year(cutoff), F.lit(False))
    host, scheme = F.lower(F.try_parse_url("url", F.lit("HOST"))), F.try_parse_url("url", F.lit("PROTOCOL"))
    trusted = F.coalesce((scheme == "https") & host.isin("openlibrary.org", "www.openlibrary.org"), F.lit(False))
    gate = (
        F.when(F.col("identity_conflict"), "identity_conflict").when(work_key(F.col("work")) == "", "unverified_work_id").when(late, "published_after_cutoff")
        .when(~trusted, "untrusted_source").when(F.size(F.coalesce("flags", F.array().cast("array<string>"))) > 0, "local_quality_gate")
    )
    judged = works.withColumn("_gate", gate)
    new = without_known(judged.where("_gate is null"), reads).select(F.col("id").alias("_new"))
    return judged.join(new, F.col("id") == F.col("_new"), "left").select("id", F.coalesce("_gate", F.when(F.col("_new").isNull(), "already_read"), F.lit("eligible")).alias("reason"))


def overlap_rejections(active: DataFrame, reads: DataFrame, shortlist: DataFrame) -> DataFrame:
    """(id, reason) of items to reject: met in the history, else in the shortlist, else a worse copy of an accepted item.

    active: id, keys, accepted, quality, description, cover, score; the others: keys.
    """
    unread = without_known(active, reads)
    fresh = without_known(unread, shortlist)
    order = [-F.coalesce("quality", F.lit(0.0)), (blank_to(F.col("description")) == "").cast("int"), (blank_to(F.col("cover")) == "").cast("int"), -F.coalesce("score", F.lit(0.0))]
    # Both overlaps compare with what lies before the step, so copies are sought among what is left.
    accepted = fresh.where("accepted")
    kept = greedy_rounds(accepted, "id", order)
    out = active.join(unread.select("id"), "id", "left_anti").select("id", F.lit("read_overlap").alias("reason"))
    out = out.unionByName(unread.join(fresh.select("id"), "id", "left_anti").select("id", F.lit("shortlisted_overlap").alias("reason")))
    return out.unionByName(accepted.join(kept.select("id"), "id", "left_anti").select("id", F.lit("duplicate_identity").alias("reason")))


def audited(rows: DataFrame) -> DataFrame:
    """(id, status, flags): a record's verdict. rows: id, flags (fatal defects), available, matched, quality, title_match, author_match.

    Fatal defects reject. Without a catalogue, or without a match in it, a record waits in
    quarantine; a match must be good in each part.
    """
    good = F.coalesce(F.forall(F.array(*[F.col(c) >= least for c, least in MATCH]), lambda x: x), F.lit(False))
    flags = F.coalesce("flags", F.array().cast("array<string>"))
    fatal = F.size(flags) > 0
    verdict = F.when(fatal, "rejected").when(F.col("available") & F.col("matched") & good, "accepted").otherwise("quarantine")
    why = F.when(~fatal & ~F.col("available"), "catalog_provider_unavailable").when(~fatal & ~F.col("matched"), "catalog_unmatched").when(~fatal & ~good, "catalog_match_ambiguous")
    return rows.select("id", verdict.alias("status"), F.array_sort(F.array_compact(F.array_append(flags, why))).alias("flags"))


def digest(items: DataFrame, sent: DataFrame, reads: DataFrame, shortlist: DataFrame, least_score: float, most: int) -> DataFrame:
    """The first ``most`` recommended items that were never sent, are neither read nor listed, and don't repeat a better one.

    items: id, status, score, updated_at, keys; sent: id; reads, shortlist: keys.
    """
    open_ = items.where((F.col("status") == "recommended") & (F.col("score") >= least_score)).join(sent.select("id").distinct(), "id", "left_anti")
    fresh = without_known(without_known(open_, reads), shortlist)
    order = [-F.col("score"), -F.unix_micros("updated_at"), -F.col("id")]
    return greedy_rounds(fresh, "id", order).orderBy(*order).limit(most)


def enrichment_order(items: DataFrame, by_genre: bool) -> list[Column]:
    """The order in which scarce catalogue requests are spent: records without genres (if genres filter), with an ISBN, without a safe cover first."""
    has_genres = (F.size(F.coalesce("genres", F.array().cast("array<string>"))) > 0) if by_genre else F.lit(False)
    return [has_genres, isbn13(F.col("isbn")).isNull(), safe_cover(F.col("cover"), F.col("url")) != "", F.col("id")]


def explained(near: DataFrame, items: DataFrame, authors: DataFrame) -> DataFrame:
    """(id, explanation): why an item scores as it does, in a fixed order.

    near: id, read_id, sim, rating, title; items: id, author, source, confidence; authors: author, best, worst (ratings read).
    """
    tell = lambda when: F.max_by("title", F.when(when, F.struct("sim", -F.col("read_id"))))
    top = lambda when: F.max(F.when(when, F.col("sim")))
    up, down = F.col("rating") >= 4, F.col("rating") <= 2
    n = near.groupBy("id").agg(tell(up).alias("ut"), top(up).alias("us"), tell(down).alias("dt"), top(down).alias("ds"))
    rows = items.join(n, "id", "left").join(authors, "author", "left")
    messages = [
        F.when((F.col("best") >= 4) & (F.col("worst") <= 2), "This author has mixed ratings in your reading history").when(F.col("best") >= 4, "You rated a book by this author highly"),
        F.when(F.col("us") > 0.25, F.concat(F.lit("Closest highly rated title: "), "ut")),
        F.when(F.col("ds") > 0, F.concat(F.lit("Reduced: similar to a 1–2★ book — "), "dt")),
        F.when(blank_to(F.col("source")) != "", F.concat(F.lit("From "), "source")),
        F.when(F.col("confidence") < 0.65, "Ranking confidence reduced because catalog details are sparse"),
    ]
    return rows.select("id", F.array_compact(F.array(*messages)).alias("explanation"))


def history_scores(reads: DataFrame, candidates: DataFrame, loo: DataFrame) -> DataFrame:
    """Every read with the score of its latest candidate, else the leave-one-out score of its own. reads: id, title, author; candidates: title, author, updated_at, id, score; loo: id, score."""
    key = F.concat_ws("\x1f", plain_part(F.col("title")), plain_part(F.col("author")))
    last = first_per(candidates.withColumn("_k", key), ["_k"], [F.col("updated_at").desc(), F.col("id").desc()]).select("_k", F.col("score").alias("_c"))
    own = loo.select("id", F.col("score").alias("_o"))
    met = reads.withColumn("_k", key).join(last, "_k", "left").join(own, "id", "left")
    return met.select("id", F.coalesce("_c", "_o").alias("score"), F.when(F.col("_c").isNotNull(), "candidate").when(F.col("_o").isNotNull(), "virtual").alias("origin"))


def identified(records: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, record): pairs of which any returned identifier is the wanted one, in ISBN-13 terms. records: record, isbns; wanted: id, isbn."""
    have = records.select("record", F.explode(F.array_distinct(F.array_compact(F.transform("isbns", isbn13)))).alias("_i"))
    return have.join(wanted.select("id", isbn13(F.col("isbn")).alias("_i")).where("_i is not null"), "_i").select("id", "record").distinct()


def reserved(items: DataFrame, by: str = "run", slot: int = 8, reach: int = 3, sacrifice: float = 2.0, similar: float = 0.9) -> DataFrame:
    """(run, id, pos, position): one slot swapped with one of the next three if it repeats an author or a vector before it and the other doesn't.

    A run is one page of items. items: run, id, pos, author, score, vec (null: never similar).
    """

    def arrange(page: pd.DataFrame) -> pd.DataFrame:
        page = page.sort_values("pos", ignore_index=True)
        row = list(range(len(page)))
        vectors = [None if v is None else np.asarray(v, float) for v in page["vec"]]

        def near(a, b) -> bool:
            norm = 0 if a is None or b is None else np.linalg.norm(a) * np.linalg.norm(b)
            return bool(norm) and float(a @ b) / norm >= similar

        def repeats(i: int) -> bool:
            return any(page["author"][i] == page["author"][o] or near(vectors[i], vectors[o]) for o in row[: slot - 1])

        if len(row) > slot and repeats(row[slot - 1]):
            for to in range(slot, min(slot + reach, len(row))):
                if page["score"][row[slot - 1]] - page["score"][row[to]] <= sacrifice and not repeats(row[to]):
                    row[slot - 1], row[to] = row[to], row[slot - 1]
                    break
        return pd.DataFrame({by: page[by].to_numpy()[row], "id": page["id"].to_numpy()[row], "pos": page["pos"].to_numpy()[row], "position": np.arange(1, len(row) + 1)})

    kinds = dict(items.dtypes)
    return items.select(by, "id", "pos", "author", "score", "vec").groupBy(by).applyInPandas(arrange, f"{by} {kinds[by]}, id {kinds['id']}, pos {kinds['pos']}, position long")


def vectors_of(rows: DataFrame, packed: str, out: str = "vec") -> DataFrame:
    """Vectors from the base64 of little-endian 32-bit floats, as snapshots hold them; what is no whole vector is null."""

    @F.pandas_udf("array<float>")
    def read(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for v in values:
            yield v.map(lambda b: None if b is None or len(b) % 4 else np.frombuffer(b, "<f4"))

    return rows.withColumn(out, read(F.try_to_binary(packed, F.lit("base64")))).drop(packed)


def packed_vectors(rows: DataFrame, vec: str, out: str = "packed") -> DataFrame:
    """The reverse of ``vectors_of``."""

    @F.pandas_udf("binary")
    def write(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())

    return rows.withColumn(out, F.base64(write(vec))).drop(vec)
