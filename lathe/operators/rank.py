"""Ranking features of context candidates against all seeds, without pairing every candidate with every seed."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import EXTENSION_WEIGHTS, chosen, complexity, suffix

#: Weights of relations, and the forms of test, configuration and documentation paths.
RELATION_WEIGHTS = {"CALLS": 0.8, "CALLED_BY": 0.8, "CONTAINS_SYMBOL": 0.6, "CONTAINED_BY": 0.6, "IMPORTS": 0.5, "IMPORTED_BY": 0.5, "IMPLEMENTS": 0.7, "EXTENDS": 0.7, "REFERENCES": 0.4, "DEFINES": 0.5}
TEST_PATH, CONFIG_PATH, DOC_PATH = r"(?i)(test_|_test\.|tests?/|spec/|__tests__/)", r"(?i)\.(json|yml|yaml|toml|ini|cfg|conf)$", r"(?i)\.(md|rst|txt|doc)$"
#: Names, kinds and words that make a main interface.
MAIN_NAMES, MAIN_KINDS, CALLABLE, PUBLIC = ("main", "init", "__init__", "setup", "configure"), ("class", "interface"), ("function", "method"), ("export", "public", "@api", "def ")


@dataclass(frozen=True)
class Weights:
    """What a ranking can be set to: the least score, and weights by suffix and by relation."""

    threshold: float = 0.1
    extensions: dict[str, float] = field(default_factory=lambda: dict(EXTENSION_WEIGHTS))
    relations: dict[str, float] = field(default_factory=lambda: dict(RELATION_WEIGHTS))

    def extension(self, path: Column) -> Column:
        return chosen(F.lower(suffix(path)), self.extensions, F.lit(1.0))

    def relation(self, kind: Column) -> Column:
        return chosen(kind, self.relations, F.lit(0.0))


def file_distances(files: DataFrame, seeds: DataFrame) -> DataFrame:
    """path and distance of every different file: 1 less the share of leading folders in common with a seed's file, of all seeds the least; 1 without seeds.

    Seeds are reduced to their folders' prefixes and depths, so files meet no
    more rows than they have folders and seeds have depths.
    """
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, 1, k), "/").alias("prefix")))
    spread = lambda df, n: df.select("path").where("path != ''").distinct().select("path", F.size(parts).alias(n), F.explode(prefixes).alias("p")).select("path", n, "p.depth", "p.prefix")
    own = spread(seeds, "seed_parts").select("depth", "prefix", "seed_parts").distinct()
    near = spread(files, "parts").join(own, ["depth", "prefix"]).groupBy("path").agg(F.min(1 - F.col("depth") / F.greatest("parts", "seed_parts")).alias("distance"))
    return files.select("path").distinct().join(near, "path", "left").withColumn("distance", F.coalesce("distance", F.lit(1.0)))


def path_similarities(files: DataFrame, seeds: DataFrame) -> DataFrame:
    """path and similarity of every different file: the Jaccard similarity of its path's parts with a seed's, of all seeds the greatest; 0 without seeds.

    Seeds whose file name isn't in the path differ in their folders and number
    of parts only, so they count once for each of these; the others are found
    by that name.
    """
    parts = F.array_distinct(F.split("path", "/"))
    own = files.select("path").where("path != ''").distinct().withColumn("parts", parts)
    seed = seeds.select("path").where("path != ''").distinct().select(F.element_at(F.split("path", "/"), -1).alias("name"), parts.alias("seed_parts"))
    folders = seed.select(F.array_sort(F.array_remove("seed_parts", F.col("name"))).alias("folders"), F.size("seed_parts").alias("n")).distinct().withColumn("group", F.xxhash64("folders", "n"))
    by_part = own.select("path", F.size("parts").alias("size"), F.explode("parts").alias("part")).join(folders.select("group", "n", F.explode("folders").alias("part")), "part")
    shared = by_part.groupBy("path", "group", "size", "n").agg(F.count(F.lit(1)).alias("both"))
    first = shared.select("path", (F.col("both") / (F.col("size") + F.col("n") - F.col("both"))).alias("similarity"))
    named = own.select("path", "parts", F.explode("parts").alias("name")).join(seed, "name")
    second = named.select("path", (F.size(F.array_intersect("parts", "seed_parts")) / F.size(F.array_union("parts", "seed_parts"))).alias("similarity"))
    best = first.union(second).groupBy("path").agg(F.max("similarity").alias("similarity"))
    return files.select("path").distinct().join(best, "path", "left").withColumn("similarity", F.coalesce("similarity", F.lit(0.0)))


def is_shown(code: Column) -> Column:
    """Whether code shows that it is public."""
    shown = F.lit(False)
    for word in PUBLIC:
        shown = shown | F.contains(F.coalesce(code, F.lit("")), F.lit(word))
    return shown


def with_code_features(codes: DataFrame, code: Column) -> DataFrame:
    """codes with what a ranking reads of a code: complexity (0 without code) and shown. Made where each code is stored once, so that texts needn't travel with candidates."""
    text = F.coalesce(code, F.lit(""))
    return codes.withColumn("complexity", F.when(text == "", 0.0).otherwise(complexity(text))).withColumn("shown", is_shown(text))


def is_main_interface(name: Column, kind: Column, shown: Column) -> Column:
    """A main function, a class or interface, or a function that doesn't begin with an underscore and is shown to be public."""
    return F.lower(name).isin(*MAIN_NAMES) | kind.isin(*MAIN_KINDS) | (kind.isin(*CALLABLE) & ~name.startswith("_") & shown)


def relevance(f: dict[str, Column]) -> Column:
    """Relevance from its features, within 0 and 1: seed, same_file, distance, relation, calls, doc, test, main, name_sim, path_sim, complexity, extension."""
    s = F.when(f["seed"], 0.9).otherwise(0.0)
    s = s + F.when(f["same_file"], 0.7).otherwise(F.greatest(F.lit(0.0), 0.5 * (1 - f["distance"])))
    s = s + 0.6 * (f["relation"] + F.when(f["calls"] > 0, F.least(F.lit(0.2), 0.05 * f["calls"])).otherwise(0.0))
    s = s + F.when(f["doc"], 0.10).otherwise(0.0) + F.when(f["test"], 0.15).otherwise(0.0) + F.when(f["main"], 0.10).otherwise(0.0)
    s = s + F.when(f["name_sim"] > 0.3, 0.2 * f["name_sim"]).otherwise(0.0) + F.when(f["path_sim"] > 0.3, 0.15 * f["path_sim"]).otherwise(0.0)
    s = s - F.when(f["complexity"] > 0.7, 0.05).otherwise(0.0)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), s * f["extension"]))


def described(symbols: DataFrame, seeds: DataFrame, names: DataFrame, weights: Weights | None = None, files: DataFrame | None = None) -> DataFrame:
    """symbols (file_path, symbol_name, symbol_type, and a key) with all features that don't depend on who calls them.

    seeds: path, name. names: name and similarity of all symbols' names with
    the seeds' (see names.best_name_similarity). files: all paths (path) of
    symbols; without it they are collected from these. Features of paths are
    worked out once for each different one.
    """
    w, path = weights or Weights(), F.col("path")
    paths = (symbols.select(F.col("file_path").alias("path")) if files is None else files.select("path")).distinct()
    near = file_distances(paths, seeds).join(path_similarities(paths, seeds), "path")
    near = near.select(path.alias("_path"), "distance", "similarity", path.rlike(DOC_PATH).alias("doc"), path.rlike(TEST_PATH).alias("test"), w.extension(path).alias("extension"))
    same = seeds.select(F.col("path").alias("_same")).distinct()
    near = near.join(same, F.col("_path") == F.col("_same"), "left")
    called = seeds.select(F.lower("name").alias("_seed")).distinct()
    alike = names.select(F.col("name").alias("_name"), F.col("similarity").alias("_name_sim")).join(called, F.col("_name") == F.col("_seed"), "left")
    rows = symbols.join(near, F.col("file_path") == F.col("_path"), "left").join(alike, F.lower("symbol_name") == F.col("_name"), "left")
    features = {
        "seed": F.col("_seed").isNotNull(), "same_file": F.col("_same").isNotNull(), "distance": F.coalesce("distance", F.lit(1.0)), "doc": F.coalesce("doc", F.lit(False)), "test": F.coalesce("test", F.lit(False)),
        "name_sim": F.coalesce("_name_sim", F.lit(0.0)), "path_sim": F.coalesce("similarity", F.lit(0.0)), "extension": F.coalesce("extension", F.lit(1.0)),
    }
    return rows.select(*symbols.columns, *[v.alias(f"_{k}") for k, v in features.items()])


def scored(candidates: DataFrame, symbols: DataFrame, on: list[str], weights: Weights | None = None) -> DataFrame:
    """candidates (relationship_type, calls, complexity, shown: see with_code_features) with score, from all features; those below the threshold are left out.

    symbols: described(), which candidates find by the columns on. So a
    candidate is joined once, however many features there are.
    """
    w = weights or Weights()
    features = ("seed", "same_file", "distance", "doc", "test", "name_sim", "path_sim", "extension")
    right = symbols.select(*[F.col(c).alias(f"_on_{c}") for c in on], F.col("symbol_name").alias("_called"), F.col("symbol_type").alias("_kind"), *[f"_{k}" for k in features])
    rows = candidates.join(right, [F.col(c) == F.col(f"_on_{c}") for c in on])
    main = is_main_interface(F.col("_called"), F.col("_kind"), F.col("shown"))
    rows = rows.withColumn("score", relevance({k: F.col(f"_{k}") for k in features} | {"relation": w.relation(F.col("relationship_type")), "calls": F.col("calls"), "main": main, "complexity": F.col("complexity")}))
    return rows.where(F.col("score") >= w.threshold).select(*candidates.columns, "score")


def in_score_order(items: DataFrame, pack: str) -> DataFrame:
    """items with place, from 1 on in each pack: the highest score first, then seeds, then the most urgent, then by id."""
    order = [F.col("score").desc(), F.col("is_seed").desc(), F.col("priority"), F.col("item_id")]
    return items.withColumn("place", F.row_number().over(Window.partitionBy(pack).orderBy(*order)))
