"""Rendering of an issue; one document, made on the driver from a small result."""

from __future__ import annotations

from string import Template

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.scalars import escape_html
from millrace.operators.relational import ARTICLES, PRIORITY

TITLE, CONTENT, UNSUBSCRIBE = "{{NEWSLETTER_TITLE}}", "{{NEWSLETTER_CONTENT}}", "{{{RESEND_UNSUBSCRIBE_URL}}}"

PAGE = Template("""<!DOCTYPE html>
<html lang="ko"><head><meta charset="utf-8"><title>$title</title></head>
<body>
<main><h1>$title</h1>
$content
</main>
<section><h2>Sources</h2><ul>
$sources
</ul></section>
<section><h2>When an issue appears</h2>
<p>With $enough articles or more, or with up to $few articles if one scores $priority or more. What waits is carried over to the next issue.</p></section>
<footer><a href="$unsubscribe">Unsubscribe</a></footer>
</body></html>
""")


def source_list(targets: DataFrame) -> DataFrame:
    """One row: a list item per board in catalogue order, names and addresses escaped."""
    item = F.concat(F.lit('<li><a href="'), escape_html(F.col("url")), F.lit('">'), escape_html(F.col("target_name")), F.lit("</a></li>"))
    held = F.array_sort(F.collect_list(F.struct("pos", item.alias("item"))))
    return targets.agg(F.array_join(F.transform(held, lambda x: x["item"]), "\n").alias("sources"))


def template(targets: DataFrame, articles: int = ARTICLES, priority: int = PRIORITY, unsubscribe: str = UNSUBSCRIBE) -> str:
    """The page with its title and content markers open."""
    return PAGE.substitute(title=TITLE, content=CONTENT, sources=source_list(targets).first()[0], enough=articles + 1, few=articles, priority=priority, unsubscribe=unsubscribe)


def rendered(page: str, title: Column, content: Column) -> Column:
    """:func:`render` of each row."""
    return F.replace(F.replace(F.lit(page), F.lit(TITLE), title), F.lit(CONTENT), content)


def render(page: str, title: str, content: str) -> str:
    return page.replace(TITLE, title).replace(CONTENT, content)
