"""String functions: font stacks, CSS times, URLs, addresses, snippets."""

from __future__ import annotations

#: Generic family names.
GENERIC = "serif sans-serif monospace cursive fantasy system-ui ui-sans-serif ui-serif ui-monospace -apple-system blinkmacsystemfont".split()
#: Patterns of monospace and serif family names.
MONO = r"(?i)mono|consolas|courier|menlo|monaco|code"
SERIF = r"(?i)serif|georgia|times|garamond|playfair|merriweather|lora|charter"
#: Texts of consent buttons, whole and in any case.
CONSENT = "accept all|accept cookies|accept|i accept|agree|i agree|got it|allow all|ok"


def parse_stack(d, s: str) -> str:
    """Families of a stack without quotes."""
    bare = d.rx_sub("trim(x)", "^[\"']|[\"']$", "")
    return d.keep(d.map(d.split(s, ","), "x", bare), "y", "y <> ''")


def first_family(d, s: str) -> str:
    """The first family that is not generic, else the first, else unknown."""
    stack = parse_stack(d, s)
    generic = ", ".join(f"'{g}'" for g in GENERIC)
    return f"coalesce({d.get(d.keep(stack, 'z', f'lower(z) NOT IN ({generic})'), 1)}, {d.get(stack, 1)}, 'unknown')"


def classify(d, s: str) -> str:
    """The serif pattern also matches a lone sans-serif."""
    return f"(CASE WHEN {d.like(s, MONO)} THEN 'monospace' WHEN {d.like(s, SERIF)} THEN 'serif' ELSE 'sans-serif' END)"


def fonts(d) -> str:
    from weftline.operators import views

    return f"SELECT DISTINCT font_family, {d.join(parse_stack(d, 'font_family'), '|')} AS stack, {first_family(d, 'font_family')} AS family, {classify(d, first_family(d, 'font_family'))} AS classification FROM ({views.type_samples(d)}) o"


def hosts(d) -> str:
    """Host, host without www, cache key of a page."""
    host = d.rx("url", "^[a-z]+://([^/:?#]+)", 1)
    key = d.sha256("concat(url, '::both')")
    return f"SELECT page_id, {host} AS host, {d.rx_sub(host, '^www[.]', '')} AS bare_host, {key} AS cache_key FROM {d.t('pages')}"


def snippets(d) -> str:
    """White space collapsed; texts of over 40 characters are cut at the last space within 40, or hard, with an ellipsis."""
    flat = f"trim({d.rx_sub('text', '[ \\t\\n\\r\\f]+', ' ')})"
    cut = d.rx("left(flat, 40)", "^(.+) [^ ]*$", 1)
    return f"SELECT doc_id, CASE WHEN length(flat) <= 40 THEN flat WHEN {cut} = '' THEN concat(left(flat, 40), '…') ELSE concat({cut}, '…') END AS snippet FROM (SELECT doc_id, {flat} AS flat FROM {d.t('documents')}) f"


def normalized(d) -> str:
    """Distinct lower-case tokens of letters and digits."""
    words = d.keep(d.split(d.rx_sub("lower(text)", r"[^a-z0-9\s]", " "), r"\s+"), "w", "w <> ''")
    return f"SELECT item_id, {d.size(d.uniq(words))} AS n_tokens, {d.join(d.sort(d.uniq(words)), ' ')} AS tokens FROM {d.t('benchmark')}"


def jaccard(d) -> str:
    """Mean Jaccard similarity of neighbouring items' tokens; two empty sets are alike."""
    words = d.uniq(d.keep(d.split(d.rx_sub("lower(text)", r"[^a-z0-9\s]", " "), r"\s+"), "w", "w <> ''"))
    t = f"SELECT item_id, {words} AS ws FROM {d.t('benchmark')}"
    common = f"cast({d.size(d.both('a.ws', 'b.ws'))} AS double)"
    return f"SELECT a.item_id AS left_id, b.item_id AS right_id, round(CASE WHEN {d.size('a.ws')} + {d.size('b.ws')} = 0 THEN 1.0 ELSE {common} / ({d.size('a.ws')} + {d.size('b.ws')} - {common}) END, 6) AS similarity FROM ({t}) a JOIN ({t}) b ON b.item_id > a.item_id AND b.item_id <= a.item_id + 3"


#: Blocked IPv4 ranges as (first address, prefix length).
BLOCKED = (("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.168.0.0", 16), ("224.0.0.0", 4), ("240.0.0.0", 4))


def addresses(d) -> str:
    """32-bit addresses against the blocked ranges."""
    test = []
    for first, bits in BLOCKED:
        a, b, c, e = map(int, first.split("."))
        low = ((a * 256 + b) * 256 + c) * 256 + e
        test.append(f"ip BETWEEN {low} AND {low + 2 ** (32 - bits) - 1}")
    s = "string" if d.spark else "varchar"
    octet = lambda k: f"cast(cast(floor(ip / {2 ** (24 - 8 * k)}) AS bigint) % 256 AS {s})"
    return f"SELECT c_custkey, concat({octet(0)}, '.', {octet(1)}, '.', {octet(2)}, '.', {octet(3)}) AS address, {' OR '.join(test)} AS blocked FROM (SELECT c_custkey, (c_custkey * 2654435761) % 4294967296 AS ip FROM {d.t('customer')}) i"


def consent(d) -> str:
    """A3: texts that look like a consent button."""
    return f"SELECT conv_id, turn, {d.like('lower(trim(text))', f'^({CONSENT})$')} AS consent, length(text) AS n FROM {d.t('conversations')}"


PLANS = {"i1_font_stacks": fonts, "i20_hosts": hosts, "i9_snippets": snippets, "i27_token_sets": normalized, "d26_jaccard": jaccard, "b25_blocked_addresses": addresses, "a3_consent_texts": consent}
