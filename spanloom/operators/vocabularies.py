"""A vocabulary for each aligner, read and looked up on the cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom.operators.tokens import special_tokens

#: Kinds of models that a tokenizer file may hold; one without a kind is read as whole words.
KINDS = ("WordLevel", "BPE", "WordPiece")


def parse(files: DataFrame) -> DataFrame:
    """aligner_id, status, and the tokens with their ids as an array, of every tokenizer file.

    files: aligner_id and spec, a JSON text. bad_json, no_vocabulary or unknown_model where it can't
    be read, duplicate_aligner where two files name one aligner. Added tokens come after the model's
    own and replace those of the same name.
    """
    read = files.select("aligner_id", F.try_parse_json("spec").alias("v"), F.count("*").over(Window.partitionBy("aligner_id")).alias("n"))
    get = lambda path, kind: F.try_variant_get("v", path, kind)
    kind = F.coalesce(get("$.model.type", "string"), F.lit("WordLevel"))
    own, added = get("$.model.vocab", "map<string,int>"), get("$.added_tokens", "array<struct<id:int,content:string>>")
    more = F.map_from_entries(F.transform(F.coalesce(added, F.array().cast("array<struct<id:int,content:string>>")), lambda t: F.struct(t["content"].alias("key"), t["id"].alias("value"))))
    named = F.map_concat(F.map_filter(own, lambda k, _: ~F.array_contains(F.map_keys(more), k)), more)
    status = (
        F.when(F.col("n") > 1, "duplicate_aligner").when(F.col("v").isNull(), "bad_json").when(own.isNull(), "no_vocabulary").when(~kind.isin(*KINDS), "unknown_model").otherwise("ok")
    )
    judged = read.withColumn("status", status)
    entries = F.transform(F.map_entries(named), lambda e: F.struct(e["key"].alias("token"), e["value"].alias("id")))
    return judged.select("aligner_id", "status", F.when(F.col("status") == "ok", entries).alias("entries"))


def tokens_of(files: DataFrame) -> DataFrame:
    """aligner_id, token and id of every file that can be read."""
    return parse(files).where("status = 'ok'").select("aligner_id", F.inline("entries"))


def of_aligners(vocab: DataFrame) -> DataFrame:
    """One row an aligner: what rows need to be tokenised by it, for a join on aligner_id.

    vocab: aligner_id, token and id. blank_id, unk_id, delimiter_id, uppercase_only; vocab_size, one
    more than the largest id; characters and character_ids, those of one character alone, in order,
    without the delimiter. Where capitals have no small letters beside them, small ASCII letters stand
    for them. A character under the id for the unknown isn't known.
    """
    special = special_tokens(vocab, ("aligner_id",))
    single = vocab.where((F.char_length("token") == 1) & (F.col("token") != "|")).join(special, "aligner_id").where(~F.col("id").eqNullSafe(F.col("unk_id")))
    small = F.col("uppercase_only") & F.col("token").rlike("^[a-z]$")
    capital = F.col("uppercase_only") & F.col("token").rlike("^[A-Z]$")
    stands: Column = F.when(small, F.array().cast("array<string>")).when(capital, F.array("token", F.lower("token"))).otherwise(F.array("token"))
    each = single.select("aligner_id", F.explode(stands).alias("ch"), "id").groupBy("aligner_id", "ch").agg(F.min("id").alias("id"))
    listed = each.groupBy("aligner_id").agg(F.array_sort(F.collect_list(F.struct("ch", "id"))).alias("c"))
    sizes = vocab.groupBy("aligner_id").agg((F.max("id") + 1).alias("vocab_size"))
    met = special.join(sizes, "aligner_id").join(listed, "aligner_id", "left")
    none = F.array().cast("array<int>")
    characters = F.coalesce(F.array_join(F.transform("c", lambda x: x["ch"]), ""), F.lit(""))
    return met.select("aligner_id", "blank_id", "unk_id", "delimiter_id", "uppercase_only", "vocab_size", characters.alias("characters"), F.coalesce(F.transform("c", lambda x: x["id"]), none).alias("character_ids"))
