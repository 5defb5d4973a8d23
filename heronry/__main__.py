"""Command line: build, search, compare, compact and bench over a store."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import HeronryError
from .functions.filters import parse
from .operators import evaluate, explain
from .operators.ingest import SINGLE
from .plans.embed import HashEmbedder, embed_chunks, embed_queries
from .plans.engine import Mode, Searcher
from .plans.index import Config
from .sources import files
from .sources.store import Store


def _store(spark: SparkSession, args: argparse.Namespace) -> Store:
    chunk, overlap = SINGLE if args.single_chunk else (args.chunk, args.overlap)
    embedder = HashEmbedder(args.dim) if args.dim else None
    return Store(spark, args.store, Config(chunk=chunk, overlap=overlap, embedder=embedder and embedder.id, dim=args.dim or None))


def build(spark: SparkSession, args: argparse.Namespace) -> None:
    """Adds a corpus to a store, which is made if it is not there; texts that it has are passed over."""
    store = _store(spark, args)
    writer = store.writer().add(files.read_corpus(spark, args.corpus))
    if args.dim:
        writer.embed(lambda chunks: embed_chunks(chunks, HashEmbedder(args.dim)))
    manifest = writer.commit()
    print(json.dumps({"generation": manifest.generation, "docs": manifest.next_doc, "chunks": manifest.next_chunk}))


def _asked(spark: SparkSession, args: argparse.Namespace, texts: dict) -> DataFrame:
    if args.dim:
        return embed_queries(spark, texts, HashEmbedder(args.dim))
    return spark.createDataFrame(list(texts.items()), "qid long, query string")


def search(spark: SparkSession, args: argparse.Namespace) -> None:
    request = Searcher(_store(spark, args).view()).search(_asked(spark, args, {0: args.query})).top_n(args.k)
    if args.mode:
        request.mode(args.mode)
    if args.filter:
        request.filter(args.filter)
    block = explain.context_block(F.col("source"), F.col("text"), F.col("matched_terms")).alias("block")
    for hit in request.exec().select("rank", "score", "source", "bm25_rank", "vector_rank", block).orderBy("rank").collect():
        print(json.dumps(hit.asDict(), ensure_ascii=False) if args.json else f"{hit['rank']}. {hit.score:.4f}\n{hit.block}\n")


def compare(spark: SparkSession, args: argparse.Namespace) -> None:
    found = Searcher(_store(spark, args).view()).compare(_asked(spark, args, {0: args.query}), args.k, parse(args.filter) if args.filter else None)
    print(files.markdown_table(found.orderBy("mode", "rank")))


def compact(spark: SparkSession, args: argparse.Namespace) -> None:
    store = _store(spark, args)
    before = store.tombstone_stats().first().asDict()
    done = {"dry_run": args.dry_run, **before}
    if not args.dry_run:
        manifest, remapped = store.compact()
        done |= {"remapped": remapped, "generation": manifest.generation, "removed": len(store.vacuum())}
    print(json.dumps(done) if args.json else "\n".join(f"{k}: {v}" for k, v in done.items()))


def bench(spark: SparkSession, args: argparse.Namespace) -> None:
    """Quality of each mode on judged queries, with a sign test against the first."""
    queries, judged = files.read_judgments(spark, args.judgments)
    view = _store(spark, args).view()
    if missing := files.unknown_sources(judged, view.docs).limit(5).collect():
        raise SystemExit(f"judged sources that the corpus does not have: {', '.join(r[0] for r in missing)}")
    asked = queries.select("qid", "query")
    if args.dim:
        texts = {r.qid: r.query for r in asked.collect()}  # judged queries, as many as a person has written
        asked = embed_queries(spark, texts, HashEmbedder(args.dim))
    runs, tables = {}, {}
    for mode in [Mode.parse(m) for m in args.modes]:
        hits = Searcher(view).search(asked).mode(mode).top_n(args.k).exec()
        runs[mode] = evaluate.metrics(hits, judged, args.k, args.threshold).cache()
        tables[f"{mode}"] = evaluate.means(runs[mode].join(queries.select("qid", "type"), "qid"))
    first, *others = runs
    signs = {}
    for mode in others:
        counts = evaluate.sign_counts(runs[mode], runs[first]).first()
        signs[f"{mode} vs {first}"] = {**counts.asDict(), "p": evaluate.sign_test(counts.better, counts.worse)}
    print(files.json_report(tables, {"k": args.k, "threshold": args.threshold, "signs": signs}))


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="heronry", description=__doc__)
    commands = top.add_subparsers(required=True)

    def command(f, *positional: str) -> argparse.ArgumentParser:
        p = commands.add_parser(f.__name__, help=(f.__doc__ or f.__name__).splitlines()[0])
        p.set_defaults(run=f)
        p.add_argument("store")
        for name in positional:
            p.add_argument(name)
        p.add_argument("--chunk", type=int, default=512)
        p.add_argument("--overlap", type=int, default=64)
        p.add_argument("--single-chunk", action="store_true")
        p.add_argument("--dim", type=int, default=0, help="dimensions of hashed vectors; 0: none")
        p.add_argument("--json", action="store_true")
        return p

    command(build, "corpus")
    for f in (search, compare):
        p = command(f, "query")
        p.add_argument("-k", type=int, default=10)
        p.add_argument("--filter", action="append")
        if f is search:
            p.add_argument("--mode")
    command(compact).add_argument("--dry-run", action="store_true")
    p = command(bench, "judgments")
    p.add_argument("-k", type=int, default=10)
    p.add_argument("--threshold", type=int, default=1)
    p.add_argument("--modes", nargs="+", default=["bm25"])
    args = top.parse_args(argv)
    spark = SparkSession.builder.appName("heronry").getOrCreate()
    try:
        args.run(spark, args)
    except HeronryError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
