
from .operators.articles import (active_slugs, article_lookup, label_dimension, match_links,  # noqa: F401
                                 unmatched_links)
from .operators.authors import active_authors, order_active_authors  # noqa: F401
from .operators.categories import distinct_categories  # noqa: F401
from .operators.extract import extract_links, with_links  # noqa: F401
from .operators.labels import label_rows, labelled_entries  # noqa: F401
from .operators.merge import insert_ignore, lookup_with_default, upsert  # noqa: F401
from .operators.reports import (feed_report, history_report, history_search, recent_labels,  # noqa: F401
                                stall_gaps, throughput_1s, throughput_last40)
from .operators.sequence import (assign_sequence, effective_cursors, latest_label, max_sequence,  # noqa: F401
                                 pad_sequence, replay_from_cursor, valid_cursor)
from .operators.taxonomy import service_record, taxonomy_definitions, universe_counts  # noqa: F401
from .sources.labels import (read_log, read_settings, save_setting, scan_label_log, stream_enabled,
                             write_label_log)  # noqa: F401
from .sources.posts import commit_posts, dead_letters, parse_messages, posts_from_lines  # noqa: F401
from .operators.asof import asof_join  # noqa: F401
from .operators.dimension_versions import DimensionStore, dimension_versions, match_links_asof  # noqa: F401
from .sources.labels import read_after, write_blocks  # noqa: F401
from .sources.versions import MirrorSink, VersionedTable  # noqa: F401
from .streaming.control import FeedStates, Gate, Switch, run_feed, switched_intervals  # noqa: F401
from .streaming.label_stream import (LabelSink, LineSink, RejectSink, counter_stream, labelled_stream,  # noqa: F401
                                     message_stream, start_label_stream, start_line_stream, throughput_stream)
from .streaming.leases import IdLeases, LeasedLogSink  # noqa: F401
from .streaming.live_series import live_series  # noqa: F401
from .streaming.latest import latest_table, read_latest, start_latest_stream  # noqa: F401
from .streaming.padding import pad_log  # noqa: F401
from .streaming.stalls import stall_alarms  # noqa: F401
from .operators.search_index import build_index, indexed_search  # noqa: F401
from .sources.replay import label_replay  # noqa: F401


def label_posts(posts, articles, bridge, authors, domain: str, dedupe_articles: bool = False,
                max_broadcast_rows: int = 200_000, **active_rule):
    """``issueLabelsForPost`` for a whole table: posts (from :func:`commit_posts`) → labelled entries.

    The active-author rule takes ``opinion``, ``us``, ``politics`` and ``threshold`` keyword parameters;
    ``dedupe_articles`` keeps one emission per (post, article); the dimension is broadcast only when it has
    at most ``max_broadcast_rows`` rows."""
    creates = posts.where("is_create")
    links = extract_links(creates, domain).selectExpr("uri", "author_did", "ts", "coalesce(record.text, '') AS text", "url_ord",
                                                      "url", "canonical_url")
    slugs = active_slugs(active_authors(articles, bridge, authors, **active_rule))
    dimension = label_dimension(articles, bridge, authors, slugs)
    return labelled_entries(match_links(links, dimension, max_broadcast_rows), dedupe_articles=dedupe_articles)
