"""Commands: ``python -m attesta index|template|query|enhance``.

``index IN... --output FOLDER`` reads files or folders into a search index; ``query --index FOLDER --question TEXT``
answers from it; ``template --output FILE`` writes a pool of templates; ``enhance IN OUT`` answers JSON lines of
(question, context).
"""

from __future__ import annotations

import argparse
import json
import os
from functools import partial

from pyspark.sql import functions as F

from attesta.functions.templates import POOL_FALLBACKS, PRESETS, Strategy
from attesta.operators.chunk import chunk_fixed, numbered
from attesta.plans import documents
from attesta.plans.answer import answer
from attesta.plans.extensions import HashEmbedder, embedding
from attesta.session import session
from attesta.sources.index import Index
from attesta.sources.readers import read_folder


def open_index(spark, path: str) -> Index:
    return Index(spark, os.path.abspath(path) if "://" not in path else path, dense=partial(embedding, embedder=HashEmbedder()))


def run_index(spark, given) -> int:
    index, n = open_index(spark, given.output), 0
    for path in given.input:
        docs = read_folder(spark, path).withColumn("id", F.sha2("source", 256)).withColumnRenamed("raw_content", "text")
        index.add_documents(docs, lambda d: numbered(chunk_fixed(d).drop("chunk_number")))
        n += docs.count()
    print(f"{n} documents, {index.store.read('chunks').count() if n else 0} chunks in {given.output}")
    return n


def run_template(_, given) -> Strategy:
    pool = Strategy("pool", [*PRESETS.values(), *POOL_FALLBACKS])
    with open(given.output, "w", encoding="utf-8") as f:
        f.write(pool.save())
    print(f"{len(pool.templates)} templates in {given.output}")
    return pool


def run_query(spark, given) -> dict:
    index = open_index(spark, given.index)
    strategy = None
    if given.templates:
        with open(given.templates, encoding="utf-8") as f:
            strategy = Strategy.load(f.read())
    asked = spark.createDataFrame([("q", given.question)], "id string, text string")
    row = answer(asked, index.store.read("chunks"), k=given.num_docs, display=given.max_display, strategy=strategy, retrieve=index.retriever(filter=given.filter)).first().asDict(recursive=True)
    total = len(row["citations"])
    print(f"Question: {row['question']}\n\n{row['answer']}\n\nCitations: {total}, {min(total, given.max_display)} shown, {max(0, total - given.max_display)} as references")
    if given.verbose:
        for c in row["citations"]:
            print(f"  [{c['number']}] ({c['type']}) {c['text'][:100]}")
    if given.output:
        with open(given.output, "w", encoding="utf-8") as f:
            json.dump(row, f, indent=2, default=str)
    return row


def main(argv: list[str] | None = None):
    args = argparse.ArgumentParser(prog="attesta", description=__doc__)
    commands = args.add_subparsers(dest="command", required=True)
    index = commands.add_parser("index")
    index.add_argument("--input", "-i", nargs="+", required=True)
    index.add_argument("--output", "-o", required=True)
    template = commands.add_parser("template")
    template.add_argument("--output", "-o", required=True)
    query = commands.add_parser("query")
    query.add_argument("--index", "-i", required=True)
    query.add_argument("--question", "-q", required=True)
    query.add_argument("--num-docs", "-n", type=int, default=5)
    query.add_argument("--max-display", type=int, default=5)
    query.add_argument("--templates", "-t")
    query.add_argument("--filter")
    query.add_argument("--output", "-o")
    query.add_argument("--verbose", "-v", action="store_true")
    enhance = commands.add_parser("enhance")
    enhance.add_argument("source")
    enhance.add_argument("target")
    given = args.parse_args(argv)
    if given.command == "enhance":
        return documents.main([given.source, given.target])
    return {"index": run_index, "template": run_template, "query": run_query}[given.command](session() if given.command != "template" else None, given)


if __name__ == "__main__":
    main()
