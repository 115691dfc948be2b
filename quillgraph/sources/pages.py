"""The markdown plugin as a module for the command line: ``ingest --plugin .../pages.py --opt root=FOLDER``."""

from __future__ import annotations

from quillgraph.sources.plugins import GraphDelta, markdown_plugin


class Pages:
    name = "pages"

    def run(self, ctx) -> GraphDelta:
        return markdown_plugin(ctx.spark, ctx.options["root"])


make_plugin = Pages
