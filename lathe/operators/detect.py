"""What a set of files is made of: frameworks, code patterns, focus areas and how hard its review is, each in one scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Name, words in file names, imports, code, and what is added to the confidence.
FRAMEWORKS = (
    ("FastAPI", ("main.py", "app.py", "api/", "routes/"), (r"from fastapi", r"import fastapi", r"from starlette"), (r"@app\.(get|post|put|delete|patch)", r"APIRouter", r"Depends\("), 0.1),
    ("Django", ("views.py", "models.py", "urls.py", "settings.py", "admin.py"), (r"from django", r"import django"), (r"class.*\(models\.Model\)", r"@login_required", r"HttpResponse"), 0.1),
    ("Flask", ("app.py", "views.py", "routes.py"), (r"from flask", r"import flask"), (r"@app\.route", r"Flask\(__name__\)", r"render_template"), 0.1),
    ("pytest", ("test_", "_test.py", "conftest.py", "tests/"), (r"import pytest", r"from pytest"), (r"@pytest\.(fixture|mark)", r"def test_", r"assert "), 0.05),
    ("unittest", ("test_", "_test.py"), (r"import unittest", r"from unittest"), (r"class.*\(unittest\.TestCase\)", r"self\.assert"), 0.05),
    ("SQLAlchemy", ("models.py", "database.py", "db.py"), (r"from sqlalchemy", r"import sqlalchemy"), (r"Column\(", r"relationship\(", r"Base\.metadata", r"Session"), 0.1),
    ("Pydantic", ("schemas.py", "models.py", "schema.py"), (r"from pydantic", r"import pydantic"), (r"class.*\(BaseModel\)", r"Field\(", r"validator"), 0.05),
    ("asyncio", (), (r"import asyncio", r"from asyncio"), (r"async def", r"await ", r"asyncio\.run", r"asyncio\.gather"), 0.05),
    ("Celery", ("tasks.py", "celery.py"), (r"from celery", r"import celery"), (r"@celery\.task", r"@shared_task", r"\.delay\("), 0.1),
    ("httpx", (), (r"import httpx", r"from httpx"), (r"httpx\.(get|post|put|delete)", r"AsyncClient"), 0.05),
    ("requests", (), (r"import requests", r"from requests"), (r"requests\.(get|post|put|delete)",), 0.05),
    ("LangChain", ("chains/", "agents/", "prompts/"), (r"from langchain", r"import langchain"), (r"LLMChain", r"PromptTemplate", r"ChatOpenAI"), 0.1),
    ("LangGraph", ("workflow", "graph"), (r"from langgraph", r"import langgraph"), (r"StateGraph", r"add_node", r"add_edge"), 0.1),
    ("Temporal", ("workflows/", "activities/", "worker"), (r"from temporalio", r"import temporalio"), (r"@workflow\.defn", r"@activity\.defn", r"workflow\.run"), 0.1),
)
#: Code patterns.
PATTERNS = (
    ("async_await", r"async\s+def|await\s+"),
    ("decorators", r"@\w+[\.\w]*\s*(\(|$)"),
    ("type_hints", r":\s*(str|int|float|bool|List|Dict|Optional|Any|Tuple)"),
    ("context_managers", r"with\s+\w+.*:"),
    ("comprehensions", r"\[.*for.*in.*\]|\{.*for.*in.*\}"),
    ("dataclasses", r"@dataclass"),
    ("exception_handling", r"try:|except\s+\w+:|raise\s+\w+"),
    ("logging", r"logger\.|logging\."),
    ("dependency_injection", r"Depends\(|@inject|Inject\["),
)
#: Areas with their priority and the words in paths that tell them.
AREAS = (
    ("Security", 1, ("auth", "login", "password", "token", "secret", "crypt", "security", "permission", "credential", "oauth", "jwt")),
    ("API Changes", 2, ("api/", "routes/", "endpoints/", "views/", "controller")),
    ("Data Layer", 2, ("models", "migrations", "database", "schema", "repository")),
    ("Test Coverage", 3, ("test",)),
    ("Configuration", 3, ("config", "settings", ".env", ".yaml", ".yml", ".json", ".toml")),
)
FILE, IMPORT, CODE, LEAST, MOST, MOST_AREAS = 0.2, 0.4, 0.3, 0.4, 10, 5


def _any(column: str, words: tuple[str, ...], fold: bool) -> Column:
    """Whether any of the regular expressions occurs."""
    return F.col(column).rlike(("(?i)" if fold else "") + "|".join(words)) if words else F.lit(False)


def frameworks(files: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Frameworks of each group of files (path, code; by keys, or all): name, confidence; at most ten, the likeliest first.

    Each word that occurs in any path counts, imports and code count once. One
    aggregate holds a flag for every word, so files are read once.
    """
    keys, flags, total = keys or [], [], {}
    seen = lambda c: F.max(F.coalesce(c, F.lit(False)).cast("int"))
    for i, (name, paths, imports, code, boost) in enumerate(FRAMEWORKS):
        flags += [seen(F.contains(F.lower("path"), F.lit(w.lower()))).alias(f"_p{i}_{k}") for k, w in enumerate(paths)]
        flags += [seen(_any("code", imports, True)).alias(f"_i{i}"), seen(_any("code", code, False)).alias(f"_c{i}")]
        hits = sum((F.col(f"_p{i}_{k}") * FILE for k in range(len(paths))), F.lit(0.0))
        total[name] = F.least(F.lit(1.0), F.round(hits + F.col(f"_i{i}") * IMPORT + F.col(f"_c{i}") * CODE + boost, 2))
    per = files.groupBy(*keys).agg(*flags)
    rows = per.select(*keys, F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(i).alias("place"), c.alias("confidence")) for i, (n, c) in enumerate(total.items())])).alias("f")).select(*keys, "f.*").where(F.col("confidence") >= LEAST)
    order = Window.partitionBy(*keys).orderBy(F.col("confidence").desc(), "place")
    return rows.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= MOST).drop("place")


def patterns(files: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Code patterns of each group of files: name, hits, confidence by the number of hits."""
    keys = keys or []
    per = files.groupBy(*keys).agg(*[F.coalesce(F.sum(F.regexp_count("code", F.lit(p))), F.lit(0)).cast("long").alias(n) for n, p in PATTERNS])
    rows = per.select(*keys, F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("hits")) for n, _ in PATTERNS])).alias("p")).select(*keys, "p.*").where("hits > 0")
    sure = F.when(F.col("hits") >= 10, 1.0).when(F.col("hits") >= 5, 0.8).when(F.col("hits") >= 2, 0.6).otherwise(0.4)
    return rows.withColumn("confidence", sure)


def focus_areas(changed: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Areas to look at first in each group of changed files (path): area, priority, files; five at most.

    found are the group's patterns(). Files by words in their paths; tests that
    are missing; concurrency where code waits; error handling where there is none.
    """
    flags = [F.sum(F.lower("path").rlike("|".join(w.replace(".", r"\.") for w in words)).cast("long")).alias(a) for a, _, words in AREAS]
    per = changed.select(*keys, "path").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("_files"), *flags)
    sure = lambda n: F.max(F.when(F.col("name") == n, F.col("confidence")))
    own = found.groupBy(*keys).agg(sure("async_await").alias("_waits"), sure("exception_handling").alias("_handles"))
    per = per.join(own, keys, "left")
    area = lambda name, priority, files, when, place: F.when(when, F.struct(F.lit(name).alias("area"), F.lit(priority).alias("priority"), files.cast("long").alias("files"), F.lit(place).alias("place")))
    parts = [area(n, p, F.col(n), F.col(n) > 0, place) for place, (n, p, _) in enumerate(AREAS)]
    parts.append(area("Missing Tests", 2, F.col("_files"), F.col("Test Coverage") == 0, 3))
    parts.append(area("Concurrency", 2, F.lit(0), F.coalesce(F.col("_waits") >= 0.6, F.lit(False)), 5))
    parts.append(area("Error Handling", 3, F.lit(0), F.coalesce(F.col("_handles") < 0.4, F.lit(True)), 6))
    rows = per.select(*keys, F.explode(F.filter(F.array(*parts), lambda x: x.isNotNull())).alias("a")).select(*keys, "a.*")
    order = Window.partitionBy(*keys).orderBy("priority", "place")
    return rows.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= MOST_AREAS).drop("place")


def complexity_score(items: Column, chars: Column, patches: Column, n_frameworks: Column, n_patterns: Column) -> Column:
    steps = lambda x, limits: sum((F.when(x > n, 1).otherwise(0) for n in limits[1:]), F.when(x > limits[0], 1).otherwise(0))
    return steps(items, (5, 15, 30)) + steps(chars, (5000, 20000, 50000)) + steps(patches, (3, 10, 20)) + steps(n_frameworks, (2, 5)) + steps(n_patterns, (3, 7))


def complexity_level(score: Column) -> Column:
    return F.when(score >= 8, "high").when(score >= 4, "medium").otherwise("low")
