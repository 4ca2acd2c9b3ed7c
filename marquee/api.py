"""The engine's calls, over one catalog."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .functions import text
from .functions import vocab as V
from .operators import engage, fuzzy, groups, mutate, rollup, search
from .plans.query import prepare
from .sources import catalog
from .sources.index import TextIndex
from .streaming import history


@dataclass(frozen=True)
class Catalog:
    """files: (file_id, file_name, file_size, caption, category, store) of both stores; stop_phrases: left out of queries; index: what searches read instead of files."""

    files: DataFrame
    stop_phrases: tuple[str, ...] = ()
    captions: bool = True
    index: TextIndex | None = None

    @property
    def _searched(self) -> DataFrame | TextIndex:
        return self.index or self.files

    def search(self, asked: str) -> DataFrame:
        """All files that the text finds, from the best; none for a text of which nothing is left."""
        q = prepare(asked, self.stop_phrases)
        found = search.search(self._searched, q, self.captions)
        return search.ranked(found, q) if q else found

    def search_page(self, asked: str, offset: int = 0, limit: int = V.PAGE_SIZE, lang: str | None = None) -> tuple[DataFrame, int | None, int]:
        """(rows, next offset or None, total); with a language the files that name it, in the order of ids."""
        q = prepare(asked, self.stop_phrases)
        found = search.search(self._searched, q, self.captions)
        if q is None:
            return found, None, 0
        if lang:
            return search.counted(found.filter(search.names(lang)), lambda rows: search.in_language(rows, lang), offset, limit)
        return search.page(found, q, offset, limit)

    def facets(self, asked: str) -> DataFrame:
        q = prepare(asked, self.stop_phrases)
        return search.facet_order(search.facets(search.search(self._searched, q, self.captions)))

    def correct(self, asked: str) -> str | None:
        q = prepare(asked, self.stop_phrases)
        return fuzzy.correct(catalog.titles(self.files), q) if q else None

    def file(self, file_id: str) -> DataFrame:
        return catalog.lookup(self.files, file_id)

    def browse(self, content_type: str | None = None, offset: int = 0, limit: int = 20) -> DataFrame:
        """Cards of a type, the newest first."""
        return groups.browse(self.files, content_type, limit, offset)

    def recent(self, offset: int = 0, limit: int = 20) -> DataFrame:
        return groups.browse(self.files, None, limit, offset)

    def cards(self, asked: str) -> DataFrame:
        q = prepare(asked, self.stop_phrases)
        found = search.search(self._searched, q, self.captions)
        return groups.search_cards(found, q) if q else groups.cards(catalog.with_keys(self.files.limit(0)))

    def details(self, title_key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(season tree, season counts, summary) of a title."""
        keyed = catalog.by_key(self.files, title_key)
        return groups.season_tree(keyed), groups.season_counts(keyed), groups.summary(keyed)

    def title_rollup(self, title: str) -> tuple[DataFrame, DataFrame]:
        """(sets, episodes) of the files that have all words of the title."""
        rows = rollup.from_catalog(self.search(title), title)
        return rollup.title_rollup(rows), rollup.episode_ranges(rows)

    def upsert(self, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(the snapshot after, status of each id)."""
        stored = catalog.federate(self.files)
        return mutate.upserted(incoming, stored), mutate.upsert_status(incoming, stored)

    def delete_matching(self, asked: str) -> tuple[DataFrame, DataFrame]:
        """(the files that stay, deleted files by store)."""
        return mutate.delete_matching(self.files, asked), mutate.deleted_counts(self.files, asked)

    def trending(self, log: DataFrame, limit: int = 20) -> DataFrame:
        """(place, label, count) of the search log (user_id, searches)."""
        return engage.trending_clean(log, limit)

    def members(self, users: DataFrame, members: DataFrame) -> DataFrame:
        return engage.user_members(users, members)

    def quota(self, downloads: DataFrame, as_of: str, limit: int = V.FREE_FILES) -> DataFrame:
        """(user_id, used, remaining) on the quota day of as_of."""
        return engage.quota_left(downloads, as_of, limit)

    def entitlement(self, users: DataFrame, members: DataFrame, usage: DataFrame, state: DataFrame, joined: DataFrame, as_of: str) -> DataFrame:
        """(user_id, decision): join, send or verify."""
        return engage.entitlement(users, members, usage, state, joined, as_of)

    def with_stop_phrases(self, new: tuple[str, ...]) -> Catalog:
        """The catalog with more stop phrases, lower-cased and each once."""
        return replace(self, stop_phrases=tuple(dict.fromkeys(p.lower() for p in (*self.stop_phrases, *new))))

    def backfill(self, messages: DataFrame, first: int, last: int, path: str, checkpoint: str) -> StreamingQuery:
        """Messages of a range of numbers saved into the catalog, resumable; see history.backfill()."""
        return history.backfill(messages, first, last, path, checkpoint, catalog.federate(self.files).select("file_id", "file_name", "caption", "category"))

    def correct_all(self, asked: DataFrame) -> DataFrame:
        """(text, base, original, score, place) for each distinct text of asked (text): the titles that it may mean."""
        texts = asked.select(text.strip_tech(F.col("text")).alias("text"))
        return fuzzy.corrections(texts, catalog.titles(self.files))

    def stats(self, users: DataFrame, chats: DataFrame, members: DataFrame, as_of: str) -> DataFrame:
        return engage.store_stats(self.files, users, chats, members, as_of)
