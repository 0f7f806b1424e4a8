"""Column-expression builders (all JVM-side built-ins; no Python UDFs)."""

from .text import (display_name, encode_uri_component, feed_status, fold_category, format_uptime,
                   html_escape, post_web_link, relative_age, slugify, tag_class, tag_display, title_default)
from .urls import (canonical_url, domain_link_pairs, filter_domain_urls, is_domain_url, js_trim, parse_urls,
                   text_link_pattern, text_links, url_parts)

__all__ = [
    "canonical_url", "display_name", "encode_uri_component", "feed_status", "fold_category", "format_uptime",
    "html_escape", "is_domain_url", "js_trim", "post_web_link", "relative_age", "slugify", "tag_class",
    "tag_display", "text_link_pattern", "text_links", "title_default", "url_parts",
]
