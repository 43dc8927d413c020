"""Command line over trace CSV files: `python -m tracelith.plans.cli COMMAND INPUT OUTPUT [options]`."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from tracelith.operators import cards, corpus, mining, within
from tracelith.plans import export
from tracelith.sources.traces import trace_csv


def tables(command: str, t: DataFrame, o: argparse.Namespace) -> dict[str, DataFrame]:
    """The named tables that a command writes."""
    top = lambda rows: {"all": rows, "top": mining.ranked(rows, o.top_k)}
    made = {
        "summarize": lambda: {"summary": corpus.corpus_summary(t), "questions": corpus.question_stats(t), "tokens": corpus.document_frequency(t)},
        "skipgrams": lambda: top(mining.mine_skipgrams(t, o.min_len, o.max_len, o.max_gap, o.support)),
        "patterns": lambda: top(mining.pattern_table(t, o.min_len, o.max_len, o.support)),
        "rules": lambda: top(mining.mine_rules(t, o.support, o.max_len, o.candidates)),
        "indicators": lambda: {"indicators": mining.indicators(t, o.min_len, o.max_len, o.support)},
        "lengths": lambda: {"per_question": (rows := within.lengths_by_question(t)), "aggregate": within.length_summary(rows)},
        "deltas": lambda: {"token_deltas": within.token_deltas(t, least_questions=o.min_questions), "count_buckets": within.count_buckets(t, o.min_questions)},
        "positions": lambda: {"position_deltas": within.position_deltas(t, o.min_questions)},
        "cards": lambda: {"cards": cards.motif_cards(t, o.min_len, o.max_len, o.support), "bundles": export.bundles(t)},
        "local": lambda: {"local": cards.local_lists(cards.local_motifs(t, o.min_len, o.max_len), o.top_k)},
    }
    if command == "all":
        return {f"{c}_{k}": df for c in ("summarize", "skipgrams", "patterns", "rules") for k, df in tables(c, t, o).items()}
    return made[command]()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("command", choices=["summarize", "skipgrams", "patterns", "rules", "all", "indicators", "lengths", "deltas", "positions", "cards", "local", "export"])
    p.add_argument("input")
    p.add_argument("output")
    p.add_argument("--delimiter", default=" ")
    p.add_argument("--trace-column", default="tokenized_trace")
    p.add_argument("--min-trace-len", type=int, default=1)
    p.add_argument("--max-trace-len", type=int)
    p.add_argument("--deduplicate", choices=["no", "all", "question"], default="no")
    p.add_argument("--max-questions", type=int)
    for name, value in (("min-len", 2), ("max-len", 4), ("max-gap", 2), ("support", 5), ("top-k", 100), ("candidates", 80), ("min-questions", 10)):
        p.add_argument(f"--{name}", type=int, default=value)
    return p


def run(spark: SparkSession, argv: list[str] | None = None) -> list[str]:
    o = parser().parse_args(argv)
    t = corpus.of_length(trace_csv(spark, o.input, o.trace_column, o.delimiter, skip_bad=True), o.min_trace_len, o.max_trace_len)
    t = corpus.distinct_traces(t, per_question=o.deduplicate == "question") if o.deduplicate != "no" else t
    t = corpus.first_questions(t, o.max_questions) if o.max_questions else t
    if o.command == "export":
        export.write_questions(t, o.output)
        return [o.output]
    made = tables(o.command, t, o)
    for name, df in made.items():
        export.write_csv(df, f"{o.output}/{name}")
    return [f"{o.output}/{n}" for n in made]


if __name__ == "__main__":
    run(SparkSession.builder.appName("tracelith").getOrCreate())
