"""Word lists, lookup tables and patterns of the catalog's rules.

All values in this module are fixed values: results are right only if they are exactly these.
"""

from __future__ import annotations

# Scores, in the order in which their keys are looked for as substrings.
RESOLUTION_SCORES = (("2160p", 200), ("4k", 200), ("uhd", 200), ("1080p", 150), ("720p", 100), ("480p", 50), ("360p", 20))
QUALITY_SCORES = (
    ("remux", 98), ("bluray", 96), ("bdrip", 94), ("web-dl", 90), ("webdl", 90), ("webrip", 85), ("hdrip", 75), ("hd", 70), ("dvdrip", 60),
    ("ts", 15), ("hdts", 14), ("cam", 10),
)
LANGUAGE_WEIGHTS = (
    ("hindi", 30), ("english", 25), ("tamil", 30), ("telugu", 30), ("malayalam", 30), ("kannada", 30), ("punjabi", 25), ("bengali", 25),
    ("gujarati", 25), ("marathi", 25), ("dual", 20), ("multi", 20),
)
LANGUAGE_WEIGHT_DEFAULT = 20
SORT_SCORES = (("2160p", 100), ("4k", 100), ("uhd", 100), ("1080p", 80), ("720p", 60), ("480p", 30), ("cam", 1))
SORT_SCORE_DEFAULT = 40

# Labels, in the order in which their keys are looked for as substrings.
QUALITY_LABELS = (("2160p", "2160p"), ("4k", "4K"), ("uhd", "4K"), ("1080p", "1080p"), ("720p", "720p"), ("480p", "480p"), ("360p", "360p"), ("cam", "CAM"))
PRINT_LABELS = (
    ("bluray", "BluRay"), ("blu-ray", "BluRay"), ("bdrip", "BDRip"), ("remux", "Remux"), ("web-dl", "WEB-DL"), ("webdl", "WEB-DL"), ("webrip", "WEBRip"),
    ("hdrip", "HDRip"), ("hdtv", "HDTV"), ("dvdrip", "DVDRip"), ("dvdscr", "DVDScr"), ("telesync", "TS"), ("cam", "CAM"),
)
SUBTITLE_LABELS = (("esub", "English"), ("hardsub", "Hardcoded"), ("subbed", "Yes"), ("subtitle", "Yes"))
LANGUAGE_LABELS = (
    ("hindi", "Hindi"), ("english", "English"), ("tamil", "Tamil"), ("telugu", "Telugu"), ("kannada", "Kannada"), ("malayalam", "Malayalam"),
    ("bengali", "Bengali"), ("punjabi", "Punjabi"), ("marathi", "Marathi"), ("dual audio", "Dual Audio"), ("dual", "Dual Audio"),
    ("multi audio", "Multi Audio"), ("multi", "Multi Audio"),
)
COMBINED_AUDIO = ("Dual Audio", "Multi Audio")

# Quality tokens and the facet code of each, and the codes from best to worst.
QUALITY_CODES = (
    ("2160p", "4k"), ("4k", "4k"), ("uhd", "4k"), ("1080p", "1080p"), ("720p", "720p"), ("480p", "480p"), ("360p", "360p"), ("bluray", "bluray"),
    ("bdrip", "bluray"), ("remux", "bluray"), ("webdl", "webdl"), ("webrip", "webrip"), ("hdrip", "hdrip"), ("dvdrip", "dvdrip"), ("hdts", "cam"),
    ("cam", "cam"), ("ts", "cam"),
)
QUALITY_TIERS = ("4k", "1080p", "720p", "480p", "360p", "bluray", "webdl", "webrip", "hdrip", "dvdrip", "cam")

# Words that don't make a title another title, and language words of queries.
FILLER_WORDS = ("the", "a", "an", "of", "in", "on", "at", "to", "and", "or", "for", "is", "movie", "movies", "film", "films")
QUERY_LANGUAGES = tuple(k for k, _ in LANGUAGE_WEIGHTS)

# Language and platform keys of feeds.
FEED_LANGUAGES = (
    ("hin", "Hindi"), ("hindi", "Hindi"), ("tam", "Tamil"), ("tamil", "Tamil"), ("kan", "Kannada"), ("kannada", "Kannada"), ("tel", "Telugu"),
    ("telugu", "Telugu"), ("mal", "Malayalam"), ("malayalam", "Malayalam"), ("eng", "English"), ("english", "English"), ("pun", "Punjabi"),
    ("punjabi", "Punjabi"), ("ben", "Bengali"), ("bengali", "Bengali"), ("mar", "Marathi"), ("marathi", "Marathi"), ("guj", "Gujarati"),
    ("gujarati", "Gujarati"), ("urd", "Urdu"), ("urdu", "Urdu"), ("kor", "Korean"), ("korean", "Korean"), ("jpn", "Japanese"), ("japanese", "Japanese"),
)
FEED_PLATFORMS = (
    ("nf", "Netflix"), ("netflix", "Netflix"), ("sonyliv", "SonyLiv"), ("sony", "SonyLiv"), ("sliv", "SonyLiv"), ("amzn", "Amazon Prime Video"),
    ("prime", "Amazon Prime Video"), ("primevideo", "Amazon Prime Video"), ("hotstar", "Disney+ Hotstar"), ("zee5", "Zee5"), ("jio", "JioHotstar"),
    ("jhs", "JioHotstar"), ("aha", "Aha"), ("hbo", "HBO Max"), ("paramount", "Paramount+"), ("apple", "Apple TV+"), ("hoichoi", "Hoichoi"),
    ("sunnxt", "Sun NXT"), ("viki", "Viki"),
)
# "web dl" is not among them, since single words are compared.
FEED_IGNORED = (
    "rarbg", "dub", "sub", "sample", "mkv", "aac", "combined", "action", "adventure", "animation", "biography", "comedy", "crime", "documentary",
    "drama", "family", "fantasy", "film-noir", "history", "horror", "music", "musical", "mystery", "romance", "sci-fi", "sport", "thriller", "war",
    "western", "hdcam", "hdtc", "camrip", "ts", "tc", "telesync", "dvdscr", "dvdrip", "predvd", "webrip", "web-dl", "tvrip", "hdtv", "webdl",
    "bluray", "brrip", "bdrip", "360p", "480p", "720p", "1080p", "2160p", "4k", "1440p", "540p", "240p", "140p", "hevc", "hdrip", "hin", "hindi",
    "tam", "tamil", "kan", "kannada", "tel", "telugu", "mal", "malayalam", "eng", "english", "pun", "punjabi", "ben", "bengali", "mar", "marathi",
    "guj", "gujarati", "urd", "urdu", "kor", "korean", "jpn", "japanese", "nf", "netflix", "sonyliv", "sony", "sliv", "amzn", "prime", "primevideo",
    "hotstar", "zee5", "jio", "jhs", "aha", "hbo", "paramount", "apple", "hoichoi", "sunnxt", "viki", "privatemoviez", "toonworld4all",
    "themoviesboss", "1tamilmv", "tamilblasters", "1tamilblasters", "skymovieshd", "extraflix", "hdm2", "moviesmod", "hdhub4u", "mkvcinemas",
    "primefix", "join", "www", "villa", "tg", "original",
)

# Patterns. All are matched without regard to case unless the text is lower-cased before.
YEAR = r"\b(19[5-9]\d|20[0-3]\d)\b"
WEB_YEAR = r"\b(19[5-9]\d|20[0-4]\d)\b"
FEED_YEAR = r"(?:19|20)\d{2}"
GAP = r"[\s._\-]*"
SEASON_EPISODE = rf"\bs(\d{{1,2}}){GAP}e(\d{{1,3}})\b"
CROSS_EPISODE = r"\b(\d{1,2})x(\d{1,3})\b"
SEASON = r"\bs(\d{1,2})\b"
EPISODE = r"\be(\d{1,3})\b"
WEB_SEASON_EPISODE = r"\bs(\d{1,2})e(\d{1,2})\b"
QUERY_COMBINED = rf"\bs(?:eason)?{GAP}(\d{{1,2}}){GAP}(?:episode|ep|e){GAP}(\d{{1,3}})\b"
QUERY_SEASON = rf"\bseason{GAP}(\d{{1,2}})\b|\bs{GAP}(\d{{1,2}})\b"
QUERY_EPISODE = rf"\b(?:episode|ep){GAP}(\d{{1,3}})\b"
QUERY_APART = rf"\b(s\d{{2}}){GAP}(e\d{{2,3}})\b"
#: In the order they apply, with the letter before the number of each group; the last one joins marks that stand apart.
QUERY_MARKS = ((QUERY_COMBINED, "se"), (CROSS_EPISODE, "se"), (QUERY_SEASON, "ss"), (QUERY_EPISODE, "e"), (QUERY_APART, "se"))
NUMBER_BOTH = r"s(?P<season>\d{1,2})e(?P<episode>\d{1,3})"
NUMBER_SEASON, NUMBER_EPISODE = r"s(?P<season>\d{1,2})\b", r"e(?P<episode>\d{1,3})\b"
NUMBER_WORDS = r"\b(?:s\d{1,2}(?:e\d{1,3})?|e\d{1,3})\b"
REQUEST_SEASON = r"(?is)(?P<rest>.*?)\s*(?:\bs(?P<season>\d{1,2}))?"
REQUEST_YEAR = r"\b((?:19|20)\d{2})\b"
QUERY_FILLER = r"\b(?:all\s+episodes?|complete\s+series|full\s+season)\b"
MOVIE_WORD = r"\b(movie|movies|film|films)\b"
EPISODE_RANGE = r"e\s*(\d{1,3})\s*[-–_]\s*e?\s*(\d{1,3})"
SEASON_PACK = r"\b(complete|full\s*season|all\s*episodes?)\b"
MULTI_AUDIO = r"\b(dual|multi)\b"
TECH_WORDS = (
    r"\b(480p|720p|1080p|2160p|4k|hdr|bluray|bdrip|remux|web[\-\s]?dl|webrip|hdrip|dvdrip|cam|ts|hdts|pdvd|scr|x264|x265|hevc|avc|av1|aac|ac3|dts|"
    r"flac|mp3|ddp5?\.?\d?|esub|subs?|subbed|dubbed|hindi|english|tamil|telugu|malayalam|kannada|punjabi|bengali|gujarati|marathi|dual|multi|hq)\b"
)
BASE_JUNK = (
    r"\b(S\d{1,2}E?\d{0,3}|Season\s*\d+|Episode\s*\d+|\d{3,4}p|BluRay|BDRip|Remux|WEBRip|WEB-DL|HDRip|DVDRip|CAM|TS|HEVC|x264|x265|AVC|AV1|AAC|"
    r"DDP5?\.?\d?|FLAC|MP3|AC3|DTS|ESub|Subs?|Hindi|Tamil|Telugu|Malayalam|Kannada|Punjabi|English|Dual|Multi|HQ|HD|UHD|SDR|HDR|Dolby)\b.*"
)
TITLE_CUT = (
    r"\b(\d{3,4}p|4k|uhd|hdr|bluray|bdrip|remux|web[\-\s]?dl|webrip|hdrip|dvdrip|cam|ts|hdts|x264|x265|hevc|avc|aac|ac3|dts|flac|mp3|esub|subs?|"
    r"dubbed|19\d{2}|20[0-3]\d|s\d{2}e\d{2,3})\b"
)
WEB_EXTENSION = r"\.(mkv|mp4|avi|mov|flv|wmv|webm|ts|m4v)$"
WEB_PUNCTUATION = r"[@\[\]()\-_\+\.]+"
WEB_JUNK = (
    r"\b(480p|720p|1080p|2160p|4k|uhd|hdr10?|hdrip|bluray|bdrip|remux|web[\-\s]?dl|webrip|webdl|hdtv|dvdrip|dvdscr|cam|telesync|ts|x264|x265|hevc|avc|"
    r"aac|ac3|mp3|ddp|dts|atmos|dolby|proper|repack|extended|unrated|amzn|nf|hulu|voot|zee5|sony|encoded|by|www|tg|@\w+)\b"
)
WEB_LANGUAGES = (
    r"\b(hindi|english|tamil|telugu|kannada|malayalam|bengali|punjabi|marathi|dual[\s\-]?audio|multi[\s\-]?audio|dubbed|subbed|hardsub|esub|hin|eng|"
    r"tam|tel)\b"
)
ANIME_WORDS = r"\b(anime|hentai|ova|ona|oad|manhwa|manhua|donghua|shonen|seinen|shoujo|josei|isekai|mecha|dubbed\s*anime|sub\s*anime)\b"
ANIME_LETTERS = r"[\x{3040}-\x{30FF}\x{4E00}-\x{9FFF}]"
FACET_SEASON = rf"\bs(\d{{1,2}})(?!\d)|\bseason{GAP}(\d{{1,2}})\b"
FACET_LANGUAGE = r"\b(hindi|english|tamil|telugu|malayalam|kannada|punjabi|bengali|gujarati|marathi|dual|multi)\b"
FACET_QUALITY = r"\b(2160p|4k|uhd|1080p|720p|480p|360p|bluray|bdrip|remux|web[\-\s]?dl|webrip|hdrip|dvdrip|hdts|cam|ts)\b"
FEED_SOURCE = r"\b(?:HDCam|HDTC|CamRip|TS|TC|TeleSync|DVDScr|DVDRip|PreDVD|WEBRip|WEB-DL|WEB DL|WebDl|TVRip|HDTV|BluRay|BRRip|BDRip|HDRip|HEVC)\b"
FEED_RESOLUTION = r"\b(?:360p|480p|540p|720p|960p|1080p|1440p|2160p|4K|240p|140p)\b"
FEED_QUALITY = (
    r"\b(?:HDCam|HDTC|CamRip|TS|TC|TeleSync|DVDScr|DVDRip|PreDVD|WEBRip|WEB-DL|TVRip|HDTV|WEB DL|WebDl|BluRay|BRRip|BDRip|360p|480p|720p|1080p|2160p|"
    r"4K|1440p|540p|240p|140p|HEVC|HDRip)\b"
)
FEED_RANGE = r"\bS(\d{1,2})[^\w\n\r]*E(?:p(?:isode)?)?0*(\d{1,2})\s*(?:to|-)\s*(?:E(?:p(?:isode)?)?)?0*(\d{1,2})"
FEED_SINGLE = r"\bS(\d{1,2})[^\w\n\r]*E(?:p(?:isode)?)?0*(\d{1,3})"
FEED_NAMED = r"Season\s*0*(\d{1,2})[\s\-,:]*Ep(?:isode)?\s*0*(\d{1,3})"
FEED_EPISODES_ONLY = r"\b(?:EP|Episode)0*(\d{1,3})\s*-\s*0*(\d{1,3})\b"
FEED_SUBTITLE = r"[\s\-_]*(?:e)?sub(?:s|title|titles)?\b"
FEED_SEPARATORS = r"[._]+|[()\[\]{}:;'–!,.?_]"
FEED_MENTION = r"""@[^ \n\r\t\.,:;!?()\[\]{}<>\\/"'=_%]+|\bwww\.[^\s\]\)]+"""
SEARCHABLE = r"^[a-zA-Z0-9 ]*$"

# Limits and thresholds.
PAGE_SIZE = 10
FREE_FILES = 1
VERIFY_GAP_SECONDS = 28800
SPELL_LEAST, SUGGEST_LEAST, IN_STORE_LEAST, IN_STORE_GAP = 82, 30, 88, 4
SPELL_TRIED, SUGGESTED = 15, 8
CARD_ROWS, CARDS = 80, 20
REFERRAL_POINTS, REFERRAL_GOAL = 10, 100
DEBOUNCE_SECONDS = 5
GROUP_DEFAULTS = (("auto_delete", "true"), ("button", "true"), ("link", "true"), ("spell_check", "true"), ("welcome", "false"))
