"""Command line: set a text as a page image, list a folder's profiles, write template pages."""

from __future__ import annotations

import argparse
from pathlib import Path

from inkframe.operators import layout
from inkframe.runtime import local_session, ship
from inkframe.sources import dims, glyphs, sinks, templates


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="inkframe", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    page = commands.add_parser("render", help="a text file as a PNG page of 2400 by 3200")
    page.add_argument("text")
    page.add_argument("out")
    page.add_argument("--paper", default="college")
    listed = commands.add_parser("profiles", help="the profiles of a folder, and what is wrong with them")
    listed.add_argument("folder")
    blank = commands.add_parser("template", help="the template pages filled in from the closed-form bank")
    blank.add_argument("folder")
    args = parser.parse_args(argv)
    spark = local_session()
    ship(spark)
    if args.command == "render":
        docs = spark.createDataFrame([(1, Path(args.text).read_text())], "doc_id long, text string")
        wide = layout.Layout(page_width=2400, page_height=3200, margin_left=206, line_height=42, char_height=25, letter_gap=1.0, word_gap=17.0)
        Path(args.out).write_bytes(layout.rendered(docs, "doc_id", dims.dummy_bank(spark), wide, paper=args.paper).first()["png"])
    elif args.command == "profiles":
        found = glyphs.read_profiles(spark, f"{args.folder}/*/profile.json")
        for name in glyphs.list_profiles(found):
            print(name)
        glyphs.profile_breaches(found).show(truncate=False)
    else:
        pages, manifest = templates.filled_pages(spark, dims.dummy_bank(spark))
        sinks.export_png(pages.selectExpr("concat('page', page) AS stem", "png"), args.folder)
        sinks.write_report(manifest, f"{args.folder}/manifest.json")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
