"""Command line: compare two folders of modules, or look a statement up in an index."""

from __future__ import annotations

import argparse


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tessera")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("compare")
    c.add_argument("old")
    c.add_argument("new")
    c.add_argument("--rules", required=True)
    c.add_argument("--out", required=True)
    c.add_argument("--rfc7950", action="store_true", help="the strict verdicts where rules have them")
    q = sub.add_parser("index")
    q.add_argument("modules")
    q.add_argument("--out", required=True)
    q.add_argument("--per-keyword", type=int)
    q = sub.add_parser("query")
    q.add_argument("index")
    q.add_argument("snippet")
    q.add_argument("--top", type=int, default=10)
    q.add_argument("--category")
    q = sub.add_parser("learn", help="compare, and copy rules for keywords that have none until nothing changes")
    q.add_argument("old")
    q.add_argument("new")
    q.add_argument("--rules", required=True)
    q.add_argument("--index", required=True)
    q.add_argument("--out", required=True, help="a new folder for the versions of the rule table")
    q = sub.add_parser("check-rules")
    q.add_argument("rules")
    q = sub.add_parser("add-rules", help="give a keyword the rules of a similar one")
    q.add_argument("rules")
    q.add_argument("keyword")
    q.add_argument("--like", required=True)
    a = p.parse_args(args)
    if a.command == "check-rules":
        from tessera.sources.rules_xml import problems

        with open(a.rules) as f:
            found = problems(f.read())
        print("\n".join(found) or "no problems")
        return int(bool(found))
    if a.command == "add-rules":
        from tessera.sources.rules_xml import save, with_clones

        with open(a.rules) as f:
            before = f.read()
        after = with_clones(before, a.like, a.keyword)
        if after == before:
            print(f"no rules of {a.like} to copy, or {a.keyword} has its own")
            return 1
        print(f"written; the former file is {save(after, a.rules)}")
        return 0

    from pyspark.sql import SparkSession

    from tessera.plans import retriever, schema_diff
    from tessera.sources import reports, yang

    spark = SparkSession.builder.appName("tessera").getOrCreate()
    if a.command == "compare":
        found = schema_diff.compare(spark, a.old, a.new, a.rules, "rfc7950" if a.rfc7950 else "default")
        reports.write_sections(found, f"{a.out}/sections")
        reports.write_text(found, f"{a.out}/report")
        reports.write_report(found, a.out)
        found.sections().groupBy("section").count().orderBy("section").show()
    elif a.command == "learn":
        from tessera.plans import learning
        from tessera.sources import rules_xml

        store = learning.RuleTable(spark, a.out)
        store.append(rules_xml.read_rules(spark, a.rules), 0)
        _, log = learning.learn(yang.read_files(spark, a.old), yang.read_files(spark, a.new), store, retriever.Retriever(spark, a.index))
        for version, keyword, similar in log:
            print(f"{version}\t{keyword}\t{similar or 'nothing similar'}")
    elif a.command == "index":
        retriever.write_index(retriever.corpus(yang.statements(yang.read_files(spark, a.modules)), a.per_keyword), a.out)
    else:
        retriever.Retriever(spark, a.index).query(a.snippet, a.top, category=a.category).orderBy("rank").show(a.top, truncate=80)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
