"""Schemas of stored tables and search documents, as Spark DDL, with the keys a later write of the same row replaces."""

from __future__ import annotations

from typing import NamedTuple


class TableSpec(NamedTuple):
    """``keys`` tell rows apart; ``order`` is how the rows of the first key are read; ``partition`` is how files are laid out."""

    columns: str
    keys: tuple[str, ...]
    order: tuple[str, ...] = ()
    partition: str | None = None


TABLES: dict[str, TableSpec] = {
    "products": TableSpec(
        "seo_id string, category array<string>, name string, normalized_name string, brand string, model string, identifier_type string, identifier_value string, condition string, "
        "average_price double, median_price double, min_price double, max_price double, estimated_value double, sold_count int, listing_count int, created_at timestamp_ntz, "
        "last_updated timestamp_ntz, sample_titles array<string>, image_url string, attributes map<string,string>, canonical_seo_id string, related_seo_ids array<string>",
        ("seo_id",),
    ),
    "product_listings": TableSpec(
        "product_seo_id string, listing_id string, title string, price double, currency string, platform int, found_at timestamp_ntz, is_sold boolean, condition string, country string, "
        "image_url string, url string, is_active boolean, inactive_since timestamp_ntz, categories array<string>",
        ("product_seo_id", "found_at", "listing_id"),
        ("found_at desc", "listing_id"),
    ),
    "price_history": TableSpec(
        "product_seo_id string, date timestamp_ntz, average_price double, median_price double, min_price double, max_price double, sample_count int",
        ("product_seo_id", "date"),
        ("date desc",),
    ),
    "listings": TableSpec(
        "id string, title string, description_short string, description string, category string, street string, locality string, region string, country string, image_urls array<string>, "
        "price double, currency string, contact string, user_id string, latitude float, longitude float, shipping string, return_policy string, price_kind int, attributes map<string,string>, "
        "found_at timestamp_ntz, created_at timestamp_ntz, sold_before timestamp_ntz, commercial boolean, metadata map<string,string>, platform int, seo_id string, categories array<string>",
        ("id", "platform"),
    ),
    "sitemap_entries": TableSpec("partition_id int, entry_index int, seo_id string, last_updated timestamp_ntz", ("partition_id", "entry_index"), ("entry_index",)),
    "flip_reports": TableSpec(
        "report_id string, created_at timestamp_ntz, reported_by string, listing_id string, listing_title string, platform string, category string, price double, listing_json string, "
        "profit double, median_price double, recent_sells_json string, reason string, current_slug string, suggested_slug string, status string",
        ("status", "created_at", "report_id"),
        ("created_at desc", "report_id"),
        "status",
    ),
}

#: Documents of the two search tables.
DOCUMENTS: dict[str, str] = {
    "listing_documents": "id string, title string, description_short string, price double, currency string, contact string, user_id string, location struct<lat:double,lon:double>, shipping string, "
    "price_flags array<string>, attributes array<struct<name:string,value:string>>, found_at timestamp_ntz, created_at timestamp_ntz, sold_before timestamp_ntz, commercial boolean, platform string",
    "product_documents": "seo_id string, categories array<string>, name string, normalized_name string, brand string, model string, identifier_type string, condition string, average_price double, "
    "median_price double, min_price double, max_price double, listing_count int, created_at timestamp_ntz, last_updated timestamp_ntz, attributes array<struct<key:string,value:string>>, "
    "sample_titles array<string>, image_url string, locations array<struct<lat:double,lon:double>>, countries array<string>, canonical_seo_id string, related_seo_ids array<string>",
}

#: Messages between crawlers and notifiers.
MESSAGES: dict[str, str] = {
    "missing_listings": "listing_id string, product_seo_id string, found_at timestamp_ntz, price double",
    "recrawl_requests": "listing_id string, url string, platform int, product_seo_id string",
    "search_listeners": "user_id string, id long, filters array<struct<name:string,value:string>>, platform int",
}
