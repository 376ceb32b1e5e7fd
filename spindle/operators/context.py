"""From ranked hits to a context that fits a token budget, and to a prompt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spindle.functions import text as T
from spindle.functions import vocabulary as V

SECTIONS = ("primary", "supporting", "configuration", "utilities", "additional")
#: Up to so many ids (8 bytes each) are broadcast to choose rows of a large table before it is shuffled.
BROADCAST_IDS = 1_000_000
WINDOWS = {"8k": 8192, "16k": 16384, "32k": 32768, "64k": 65536, "128k": 131072}
#: Tasks that a prompt may have: role, instructions and limits of the answer, in our own words.
GENERAL = "general_question"
TASKS = {
    "general_question": ("You know this repository well and answer questions on it.", "Answer the question from the context.", "Keep it short and name the files you used."),
    "code_explanation": ("You explain code to a colleague.", "Say what the code does, step by step, and how its parts call each other.", "Start with one sentence on the purpose; name files and lines."),
    "bug_analysis": ("You look for faults in code.", "Find what may go wrong, how to set it off, and how to mend it.", "List faults by weight, each with file and lines; say so if there are none."),
    "architecture_review": ("You review the design of software.", "Judge the parts, their borders and what depends on what.", "Give strengths, then risks, then proposals."),
    "repository_search": ("You find places in a repository.", "Name where the context shows what is asked for.", "A list of files, symbols and lines, best first."),
    "code_generation": ("You write code for this repository.", "Write what is asked for in the style of the context.", "Whole functions only, with the file that each belongs to."),
    "code_refactoring": ("You tidy code without changing what it does.", "Propose a clearer form of the code in question.", "Show the new code and say why it does the same."),
    "repository_editing": ("You edit files of this repository.", "Make the change that is asked for and nothing else.", "One JSON object with a summary and a list of edits: action, path, target_path and new_content, with whole contents."),
}
RULES = "Rules:\n- Use nothing but the context below.\n- Name the file and lines of all that you refer to.\n- If the context isn't enough, say which files are missing."
TITLES = {"primary": "Main matches", "supporting": "What they depend on", "configuration": "Settings", "utilities": "Helpers", "additional": "Further references"}


def window_tokens(window: str | int) -> int:
    return max(1024, window) if isinstance(window, int) else WINDOWS.get(window, WINDOWS["16k"])


def budget(window: str | int, reserve: float = 0.25, scaffold: int = 700) -> int:
    return max(256, int(window_tokens(window) * (1 - reserve)) - scaffold)


def budget_column(window: Column, reserve: float = 0.25, scaffold: int = 700) -> Column:
    """The budget of a window named like 8k or told as a number of tokens; any other name is taken as 16k."""
    named = F.element_at(F.create_map(*[F.lit(x) for name, tokens in WINDOWS.items() for x in (name, tokens)]), window)
    told = F.greatest(F.lit(1024), window.try_cast("long"))
    tokens = F.coalesce(named.cast("long"), F.when(window.try_cast("long").isNotNull(), told), F.lit(WINDOWS["16k"]).cast("long"))
    return F.greatest(F.lit(256), F.floor(tokens * (1 - reserve)) - scaffold)


def best_of_key(rows: DataFrame, keys: list[str], score: str, ordinal: str) -> DataFrame:
    """The row of each key with the highest score, of equal ones the first; first_ordinal is the key's first place."""
    own = Window.partitionBy(*keys)
    ranked = rows.withColumns({"_r": F.row_number().over(own.orderBy(F.desc(score), ordinal)), "first_ordinal": F.min(ordinal).over(own)})
    return ranked.where("_r = 1").drop("_r")


def with_rows(hits: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """hits, which are written already, with the columns of rows of their key.

    Of rows only those that hits name are shuffled, as long as hits name few keys; beyond that all are.
    """
    ids = hits.select(key).where(F.col(key).isNotNull()).distinct()
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        rows = rows.join(F.broadcast(ids), key, "left_semi")
    return hits.join(rows, key)


def section(kind: Column, source: Column, depth: Column) -> Column:
    return (
        F.when(kind == "config_file", "configuration")
        .when((source == "dependency_expansion") | (depth > 0), "supporting")
        .when(kind.isin(*V.UTILITY_TYPES), "utilities")
        .when((depth == 0) & (source == "semantic"), "primary")
        .otherwise("additional")
    )


def section_rank(name: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for i, s in enumerate(SECTIONS) for x in (s, i)]), name), F.lit(99))


def rendered(path: Column, symbol: Column, content: Column) -> Column:
    return F.concat(F.lit("// "), path, F.lit(" :: "), symbol, F.lit("\n"), content)


def compressed(content: Column, head: int = 24, tail: int = 8) -> Column:
    """The first and last lines and a note in between; null for a text with no more lines than those."""

    def cut(lines: Column) -> Column:
        n = F.size(lines)
        note = F.concat(F.lit("    // ... "), (n - head - tail).cast("string"), F.lit(" lines omitted for brevity ..."))
        parts = F.concat(F.slice(lines, 1, head), F.array(note), F.slice(lines, F.lit(-tail), F.lit(tail)))
        return F.when(n > head + tail, F.array_join(parts, "\n"))

    return T.let(T.lines(content), cut)


def packed(chunks: DataFrame, limit: int, over: int = 700) -> DataFrame:
    """chunks (query_id, place, path, symbol, content, ...) with tokens, state and used.

    In order of place each chunk is taken if it fits what is left of limit; else, if it is long and
    can be compressed, in that form; else it is trimmed and the next one is tried. The fold runs over
    a query's chunks, which retrieval bounds.
    """
    full = T.token_estimate(rendered(F.col("path"), F.col("symbol"), F.col("content")))
    short = T.token_estimate(rendered(F.col("path"), F.col("symbol"), compressed(F.col("content"))))
    sized = chunks.withColumns({"_full": full, "_short": F.when((full > over) & compressed(F.col("content")).isNotNull(), short)})
    entry = F.struct("place", F.col("_full").alias("full"), F.col("_short").alias("short"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<place:int,tokens:bigint,state:string>>").alias("out"))

    def step(acc: Column, e: Column) -> Column:
        fits, tight = acc["used"] + e["full"] <= limit, F.coalesce(acc["used"] + e["short"] <= limit, F.lit(False))
        tokens = F.when(fits, e["full"]).when(tight, e["short"]).otherwise(F.lit(0))
        state = F.when(fits, "taken").when(tight, "compressed").otherwise("trimmed")
        row = F.struct(e["place"].cast("int").alias("place"), tokens.cast("bigint").alias("tokens"), state.alias("state"))
        return F.struct((acc["used"] + tokens).cast("bigint").alias("used"), F.concat(acc["out"], F.array(row)).alias("out"))

    folded = sized.groupBy("query_id").agg(F.array_sort(F.collect_list(entry)).alias("all")).select("query_id", F.aggregate("all", start, step).alias("f"))
    states = folded.select("query_id", F.explode("f.out").alias("o")).select("query_id", "o.place", "o.tokens", "o.state")
    return chunks.join(states, ["query_id", "place"])


def statistics(context: DataFrame) -> DataFrame:
    """query_id with used_tokens, included, compressed and trimmed chunks, and the trimmed symbols in order of place, of packed rows."""
    state = F.col("state")
    trimmed = F.array_sort(F.collect_list(F.when(state == "trimmed", F.struct("place", "symbol"))))
    return context.groupBy("query_id").agg(
        F.sum("tokens").cast("long").alias("used_tokens"), F.count_if(state != "trimmed").alias("included"), F.count_if(state == "compressed").alias("compressed"), F.count_if(state == "trimmed").alias("trimmed"),
        F.array_join(F.transform(trimmed, lambda t: t["symbol"]), ",").alias("trimmed_symbols"),
    )


def summary(context: DataFrame, repository: Column) -> DataFrame:
    """query_id and one sentence on the chunks (path, language, framework) that a context includes: frameworks, languages and number of files, if there are any."""
    kept = context.where("state <> 'trimmed'").withColumn("repository_name", repository)
    names = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(F.col(c) != "", F.col(c)))), ", ")
    own = kept.groupBy("query_id").agg(F.max("repository_name").alias("name"), names("framework").alias("frameworks"), names("language").alias("languages"), F.count_distinct("path").alias("files"))
    parts = F.array(
        F.concat(F.lit("Repository '"), F.col("name"), F.lit("'")),
        F.when(F.col("frameworks") != "", F.concat(F.lit("framework: "), F.col("frameworks"))), F.when(F.col("languages") != "", F.concat(F.lit("languages: "), F.col("languages"))),
        F.concat(F.col("files").cast("string"), F.lit(" relevant file(s) in context")),
    )
    return own.select("query_id", F.concat(F.array_join(parts, "; "), F.lit(".")).alias("summary"))


def shown_sources(context: DataFrame, files: int = 8, symbols: int = 10) -> DataFrame:
    """query_id, the first distinct files and symbols of included chunks in order of place, and how many more chunks than those shown there are; top_score is the best of them."""
    kept = context.where("state <> 'trimmed'").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", "path", "symbol"))).alias("own"), F.max("final").alias("top_score"))
    first = lambda c, n: F.slice(F.array_distinct(F.transform("own", lambda x: x[c])), 1, n)
    more = lambda n: F.greatest(F.size("own") - n, F.lit(0)).cast("long")
    return kept.select("query_id", F.array_join(first("path", files), ",").alias("files"), more(files).alias("more_files"), F.array_join(first("symbol", symbols), ",").alias("symbols"), more(symbols).alias("more_symbols"), F.round("top_score", 6).alias("top_score"))


def prompts(context: DataFrame, questions: DataFrame) -> DataFrame:
    """query_id, prompt and tokens: sections in order, each with its chunks in order of place, then the question."""
    header = F.concat(F.lit("## "), F.col("symbol"), F.lit(" ("), F.col("kind"), F.lit(") — "), F.col("path"), F.when(F.col("state") == "compressed", " (compressed)").otherwise(""))
    body = F.when(F.col("state") == "compressed", compressed(F.col("content"))).otherwise(F.col("content"))
    chunk = F.concat(header, F.lit("\n```\n"), body, F.lit("\n```"))
    kept = context.where("state <> 'trimmed'").select("query_id", "section", "place", chunk.alias("chunk"))
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("_o", c))), lambda s: s[c])
    by_section = kept.withColumn("_o", F.col("place")).groupBy("query_id", "section").agg(F.array_join(in_order("chunk"), "\n\n").alias("text"))
    title = F.element_at(F.create_map(*[F.lit(x) for kv in TITLES.items() for x in kv]), F.col("section"))
    titled = by_section.select("query_id", section_rank(F.col("section")).alias("_o"), F.concat(F.lit("# "), title, F.lit("\n"), F.col("text")).alias("text"))
    whole = titled.groupBy("query_id").agg(F.array_join(in_order("text"), "\n\n").alias("text"))
    out = questions.join(whole, "query_id", "left")
    text = F.concat(F.coalesce(F.concat("text", F.lit("\n\n")), F.lit("")), F.lit("# Question\n"), F.col("question"))
    return out.select("query_id", text.alias("prompt"), T.token_estimate(text).alias("tokens"))


def system_prompts(questions: DataFrame) -> DataFrame:
    """questions (query_id, task, ...) with system: role, task, rules and what an answer must look like; unknown tasks and null are general ones."""
    columns = "task string, role string, instructions string, limits string"
    table = F.broadcast(questions.sparkSession.createDataFrame([(k, *v) for k, v in TASKS.items()], columns))
    general = F.when(F.col("task").isin(*TASKS), F.col("task")).otherwise(GENERAL)
    own = questions.withColumn("task", general).join(table, "task")
    return own.withColumn("system", F.concat_ws("\n\n", "role", F.concat(F.lit("Task: "), F.col("instructions")), F.lit(RULES), "limits")).drop("role", "instructions", "limits")


def task_prompts(prompts: DataFrame, questions: DataFrame) -> DataFrame:
    """query_id, task, system, user and tokens of both: prompts (query_id, prompt) under the repository's name and summary.

    questions: (query_id, task, repository, summary); without summary its line is left out.
    """
    about = F.concat_ws("\n\n", F.concat(F.lit("# Repository: "), F.col("repository")), F.concat(F.lit("Summary: "), F.col("summary")), "prompt")
    own = system_prompts(questions).join(prompts.select("query_id", "prompt"), "query_id").withColumn("user", about)
    return own.select("query_id", "task", "system", "user", T.token_estimate(F.concat_ws("\n\n", "system", "user")).alias("tokens"))
