"""The library's ten tables: schemas, keys, references and length limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = {
    "users": "user_id string, email string, created_at timestamp",
    "feeds": "feed_id string, rss_url string, title string, author string, description string, image_url string, category string, etag string, last_modified string, last_fetched_at timestamp, sync_status string, error_count int, created_at timestamp",
    "episodes": "episode_id string, feed_id string, guid string, title string, audio_url string, duration int, published_at timestamp, summary string, transcript string, processed boolean, created_at timestamp",
    "user_episode_progress": "user_id string, episode_id string, position_seconds int, completed boolean, last_played_at timestamp",
    "tags": "tag_id string, name string, category string",
    "episode_tags": "episode_id string, tag_id string",
    "insights": "insight_id string, episode_id string, timestamp_seconds int, title string, detail string, insight_type string, created_at timestamp",
    "curated_playlists": "playlist_id string, user_id string, title string, description string, query_prompt string, created_at timestamp",
    "playlist_episodes": "playlist_id string, episode_id string, position int",
    "task_logs": "task_log_id string, task_type string, payload_json string, status string, error_message string, created_at timestamp",
}
PRIMARY_KEYS = {"users": ["user_id"], "feeds": ["feed_id"], "episodes": ["episode_id"], "user_episode_progress": ["user_id", "episode_id"], "tags": ["tag_id"], "episode_tags": ["episode_id", "tag_id"], "insights": ["insight_id"], "curated_playlists": ["playlist_id"], "playlist_episodes": ["playlist_id", "episode_id"], "task_logs": ["task_log_id"]}
UNIQUE = {"users": ["email"], "feeds": ["rss_url"], "episodes": ["feed_id", "guid"], "tags": ["name", "category"]}
#: child -> [(column, parent)]; a parent's row takes its children with it.
REFERENCES = {"episodes": [("feed_id", "feeds")], "insights": [("episode_id", "episodes")], "episode_tags": [("episode_id", "episodes"), ("tag_id", "tags")], "user_episode_progress": [("user_id", "users"), ("episode_id", "episodes")], "curated_playlists": [("user_id", "users")], "playlist_episodes": [("playlist_id", "curated_playlists"), ("episode_id", "episodes")]}
LENGTHS = {"users": {"email": 255}, "feeds": {"rss_url": 1024, "title": 512, "author": 255, "image_url": 1024, "category": 255, "etag": 255, "last_modified": 255, "sync_status": 50}, "episodes": {"guid": 512, "title": 512, "audio_url": 1024}, "tags": {"name": 255, "category": 100}, "insights": {"title": 512, "insight_type": 100}, "curated_playlists": {"title": 512}, "task_logs": {"task_type": 100, "status": 50}}
DEFAULTS = {"feeds": {"sync_status": "pending", "error_count": 0}, "episodes": {"processed": False}, "user_episode_progress": {"position_seconds": 0, "completed": False}, "playlist_episodes": {"position": 0}, "task_logs": {"status": "pending"}}


def create(spark: SparkSession, root: str, name: str) -> None:
    """Writes an empty table where there is none."""
    spark.createDataFrame([], TABLES[name]).write.mode("ignore").parquet(f"{root}/{name}")


def scan(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{root}/{name}")


def conform(rows: DataFrame, name: str) -> DataFrame:
    """rows with the table's columns in its types: a column that rows lack has its default, or null; others go."""
    given, told = set(rows.columns), DEFAULTS.get(name, {})
    fields = [c.strip().split(" ") for c in TABLES[name].split(",")]
    return rows.select(*((F.col(c) if c in given else F.lit(told.get(c))).cast(t).alias(c) for c, t in fields))
