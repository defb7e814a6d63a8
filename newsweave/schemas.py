"""Schemas of the inputs and the stored tables."""

from __future__ import annotations

ENTRY = "feed_ord int, entry_ord bigint, link string, title string, summary string, description string, published timestamp_ntz"
RAW_ENTRY = "feed_ord int, entry_ord bigint, link string, title string, published string"
PAGE = "url string, html string"
IDENTITY = "id bigint, title string, link string, published_date timestamp_ntz"
DETAILS = "id bigint, article_id bigint, summary string, source string, keywords_matched string, tags string, is_whitelisted boolean"
CASES = "id bigint, article_id bigint, disease_name string, case_count int, location string, report_date timestamp_ntz"
WHITELIST = "id bigint, domain string, is_active boolean"
KEYWORDS = "id bigint, text string, created_at timestamp_ntz"
TABLES = {"article_identity": IDENTITY, "article_details": DETAILS, "disease_cases": CASES, "whitelist_domains": WHITELIST, "keywords": KEYWORDS}
