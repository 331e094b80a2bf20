"""DuckDB SQL of the training-data queries that SQL can express."""

_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
_ASCII = "".join(map(chr, range(0x21, 0x7F))).replace("'", "''")
_UNSEEN = r"\x{AD}\x{34F}\x{61C}\x{180E}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{2066}-\x{206F}\x{FEFF}"
_MARKS = r"\x{300}-\x{34E}\x{350}-\x{36F}\x{1AB0}-\x{1AFF}\x{1DC0}-\x{1DFF}\x{20D0}-\x{20FF}\x{FE20}-\x{FE2F}"
_SPACES = r"\x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}"


def _plain(c: str) -> str:
    return f"translate(regexp_replace({c}, '[{_UNSEEN}]', '', 'g'), '{_WIDE}', '{_ASCII}')"


def _odd(c: str) -> str:
    """Whether a text holds characters of other kinds than they look; words are runs of letters, digits and marks."""
    mixed = rf"len(list_filter(regexp_extract_all({_plain(c)}, '[\p{{L}}\p{{Nd}}\p{{M}}]+'), lambda w: regexp_matches(w, '\p{{Latin}}') AND regexp_matches(w, '[\p{{Cyrillic}}\p{{Greek}}\p{{Armenian}}]'))) > 0"
    return rf"(regexp_matches({c}, '[\x{{FF01}}-\x{{FF5E}}{_MARKS}{_UNSEEN}{_SPACES}]') OR {mixed})"


def _windows(table: str, key: str) -> str:
    """Every run of twelve words of a table's texts."""
    words = rf"SELECT {key}, regexp_extract_all(lower({_plain('text')}), '[\p{{L}}\p{{N}}]+') AS w FROM {table} WHERE text IS NOT NULL"
    return f"SELECT DISTINCT {key}, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) AS run FROM ({words}) WHERE len(w) >= 12"


SQL: dict[str, str] = {
    "p2_found": f"SELECT DISTINCT id, 'title' AS field FROM listings WHERE {_odd('title')} UNION ALL SELECT DISTINCT id, 'description' FROM listings WHERE {_odd('description')}",
    "p9_found": f"SELECT DISTINCT doc_id, item_id FROM ({_windows('documents', 'doc_id')}) JOIN ({_windows('eval_items', 'item_id')}) USING (run)",
    "p5_found": """
        SELECT p.seo_id FROM products p JOIN (
            SELECT product_seo_id, count(*) AS n, median(price) AS m FROM (
                SELECT product_seo_id, listing_id, found_at, min(price) AS price FROM product_listings
                WHERE currency = 'EUR' AND price > 0 GROUP BY 1, 2, 3) GROUP BY 1) t ON t.product_seo_id = p.seo_id
        WHERE t.n >= 20 AND abs(p.median_price - t.m) > 0.1 * t.m""",
    "p5_percentiles": """
        SELECT product_seo_id, count(*) AS n, round(quantile_cont(price, 0.25), 6) AS p25, round(quantile_cont(price, 0.5), 6) AS p50,
               round(quantile_cont(price, 0.75), 6) AS p75, round(quantile_cont(price, 0.9), 6) AS p90
        FROM (SELECT product_seo_id, listing_id, found_at, min(price) AS price FROM product_listings
              WHERE currency = 'EUR' AND price > 0 AND product_seo_id IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1""",
    "p8_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
