"""Tags of static pages: predicates, navigation and bands, by tokens alone. Element trees are read by weftline.sources.html_nodes and folded by layout.py."""

from __future__ import annotations

from weftline.plans.dialect import step

@step(cut=True)
def tags(d) -> str:
    """Tags of a page in order, without scripts and styles. Elements that may be left open count as empty."""
    bare = d.rx_sub("html", "(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->", "")
    every = d.rx_all(bare, "<(/?[a-zA-Z!][a-zA-Z0-9]*)", 1)
    if d.spark:
        rows = f"SELECT page_id, pos + 1 AS ord, lower(tok) AS tok FROM (SELECT page_id, posexplode({every}) AS (pos, tok) FROM {d.t('pages')}) e"
    else:
        rows = f"SELECT page_id, unnest(range(1, len(toks) + 1)) AS ord, lower(unnest(toks)) AS tok FROM (SELECT page_id, {every} AS toks FROM {d.t('pages')}) e"
    return f"SELECT page_id, cast(ord AS int) AS ord, {d.rx_sub('tok', '^/', '')} AS tag, CASE WHEN tok LIKE '/%' THEN -1 ELSE 1 END AS kind FROM ({rows}) r"


def predicates(d) -> str:
    """Interactive by both rules, images, landmarks."""
    return f"SELECT page_id, ord, tag, tag IN ('a', 'button', 'summary') AS interactive_style, tag IN ('a', 'button', 'input', 'select', 'textarea', 'option') AS interactive_tree, tag IN ('img', 'svg', 'picture', 'canvas') AS image, CASE WHEN tag IN ('header', 'nav', 'main', 'aside', 'footer', 'section', 'article') THEN tag END AS landmark FROM ({tags(d)}) n WHERE kind = 1"


def in_nav(d) -> str:
    """Elements inside a nav, by the tags that are open at them."""
    return f"SELECT page_id, count(*) AS elements, count_if(open_navs > 0) AS in_nav FROM (SELECT *, sum(CASE WHEN tag = 'nav' THEN kind ELSE 0 END) OVER (PARTITION BY page_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS open_navs FROM ({tags(d)}) t) o WHERE kind = 1 GROUP BY page_id"


def sections(d) -> str:
    """Bands of a page in order with their headings, paragraphs and links."""
    band = f"SELECT *, sum(CASE WHEN kind = 1 AND tag IN ('nav', 'article', 'footer') THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS band FROM ({tags(d)}) t"
    return f"SELECT page_id, cast(band AS int) AS band, {'min_by' if d.spark else 'arg_min'}(tag, ord) AS tag, count_if(kind = 1 AND tag IN ('h1', 'h2', 'h3')) AS headings, count_if(kind = 1 AND tag = 'p') AS paragraphs, count_if(kind = 1 AND tag = 'a') AS actions FROM ({band}) b WHERE band > 0 GROUP BY page_id, band"


PLANS = {"a9_page_tags": lambda d: f"SELECT page_id, ord, tag, kind FROM ({tags(d)}) t", "b8_element_predicates": predicates, "b12_in_nav": in_nav, "j8_sections": sections}
