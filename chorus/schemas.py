"""Schemas of the stored tables and the fixed lookup values.

Everything under "FIXED VALUES" must equal what the analysed application uses, so it is
written out plainly, in its natural order.
"""

from __future__ import annotations

import string

from pyspark.sql import types as T

# --------------------------------------------------------------------------------------
# Stored tables
# --------------------------------------------------------------------------------------

VIDEO_SCHEMA = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("videoName", T.StringType(), True),
    T.StructField("channelName", T.StringType(), True),
    T.StructField("videoKey", T.StringType(), True),
    T.StructField("category", T.StringType(), True),
    T.StructField("viewCount", T.LongType(), True),
    T.StructField("likeCount", T.LongType(), True),
    T.StructField("commentCount", T.LongType(), True),
    T.StructField("publishingDate", T.TimestampNTZType(), True),
])

COMMENT_SCHEMA = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("videoId", T.LongType(), False),
    T.StructField("commentText", T.StringType(), True),
    T.StructField("sentiment", T.StringType(), True),
    T.StructField("likeCount", T.LongType(), True),
    T.StructField("publishingDate", T.TimestampNTZType(), True),
])

# The comment dataset CSV, read by header with an explicit schema (never inferred).
DATASET_SCHEMA = T.StructType([
    T.StructField("CommentID", T.StringType(), True),
    T.StructField("VideoID", T.StringType(), True),
    T.StructField("VideoTitle", T.StringType(), True),
    T.StructField("AuthorName", T.StringType(), True),
    T.StructField("AuthorChannelID", T.StringType(), True),
    T.StructField("CommentText", T.StringType(), True),
    T.StructField("Sentiment", T.StringType(), True),
    T.StructField("Likes", T.LongType(), True),
    T.StructField("Replies", T.LongType(), True),
    T.StructField("PublishedAt", T.TimestampNTZType(), True),
    T.StructField("CountryCode", T.StringType(), True),
    T.StructField("CategoryID", T.IntegerType(), True),
])

LANGUAGE_SIDECAR_SCHEMA = T.StructType([
    T.StructField("CommentID", T.StringType(), True),
    T.StructField("Language", T.StringType(), True),
])

# Landed video-metadata response (one JSON document per line).
VIDEO_PAGE_SCHEMA = T.StructType([
    T.StructField("pageInfo", T.StructType([T.StructField("totalResults", T.IntegerType())])),
    T.StructField("items", T.ArrayType(T.StructType([
        T.StructField("id", T.StringType()),
        T.StructField("snippet", T.StructType([
            T.StructField("title", T.StringType()),
            T.StructField("channelTitle", T.StringType()),
            T.StructField("publishedAt", T.StringType()),
            T.StructField("categoryId", T.StringType()),
        ])),
        T.StructField("statistics", T.StructType([
            T.StructField("viewCount", T.StringType()),
            T.StructField("likeCount", T.StringType()),
            T.StructField("commentCount", T.StringType()),
        ])),
    ]))),
])

# Landed comment page (one JSON document per line).
COMMENT_PAGE_SCHEMA = T.StructType([
    T.StructField("nextPageToken", T.StringType()),
    T.StructField("items", T.ArrayType(T.StructType([
        T.StructField("id", T.StringType()),
        T.StructField("snippet", T.StructType([
            T.StructField("videoId", T.StringType()),
            T.StructField("topLevelComment", T.StructType([
                T.StructField("snippet", T.StructType([
                    T.StructField("textDisplay", T.StringType()),
                    T.StructField("likeCount", T.LongType()),
                    T.StructField("publishedAt", T.StringType()),
                ])),
            ])),
        ])),
    ]))),
])

#: The same as pages are landed: numbers and dates as text, so that a feed that starts to quote them is still read, and a place for what is no page.
COMMENT_LANDING_SCHEMA = T.StructType([
    *(f if f.name != "items" else T.StructField("items", T.ArrayType(T.StructType([
        T.StructField("id", T.StringType()),
        T.StructField("snippet", T.StructType([
            T.StructField("videoId", T.StringType()),
            T.StructField("topLevelComment", T.StructType([
                T.StructField("snippet", T.StructType([
                    T.StructField(c, T.StringType()) for c in ("textDisplay", "likeCount", "publishedAt")])),
            ])),
        ])),
    ]))) for f in COMMENT_PAGE_SCHEMA.fields),
    T.StructField("_corrupt_record", T.StringType()),
])

RUN_LOG_SCHEMA = T.StructType([
    T.StructField("run_id", T.StringType(), False),
    T.StructField("key", T.StringType(), False),
    T.StructField("value", T.StringType(), True),
    T.StructField("kind", T.StringType(), False),
    T.StructField("ts", T.TimestampNTZType(), False),
])

# ======================================================================================
# FIXED VALUES (must equal the analysed application's values)
# ======================================================================================

# Sentiment enum and the label ids used by the classifiers.
SENTIMENTS = ["Positive", "Neutral", "Negative"]
LABEL_IDS = {"Positive": 0, "Neutral": 1, "Negative": 2}
ID_LABELS = {0: "Positive", 1: "Neutral", 2: "Negative"}
# Custom sort order of the sentiment axis in reports.
SENTIMENT_ORDER = {"Positive": 0, "Neutral": 1, "Negative": 2}

# Video category id -> name.
CATEGORIES = {
    1: "Film & Animation",
    2: "Autos & Vehicles",
    10: "Music",
    15: "Pets & Animals",
    17: "Sports",
    18: "Short Movies",
    19: "Travel & Events",
    20: "Gaming",
    21: "Videoblogging",
    22: "People & Blogs",
    23: "Comedy",
    24: "Entertainment",
    25: "News & Politics",
    26: "Howto & Style",
    27: "Education",
    28: "Science & Technology",
    29: "Nonprofits & Activism",
    30: "Movies",
    31: "Anime/Animation",
    32: "Action/Adventure",
    33: "Classics",
    34: "Comedy",
    35: "Documentary",
    36: "Drama",
    37: "Family",
    38: "Foreign",
    39: "Horror",
    40: "Sci-Fi/Fantasy",
    41: "Thriller",
    42: "Shorts",
    43: "Shows",
    44: "Trailers",
}
NO_CATEGORY = "No category"

# Stopwords excluded from word counts (as listed; duplicates collapse in the set).
STOPWORDS_LISTED = [
    "a", "about", "above", "after", "again", "against", "all", "am", "an", "and", "any", "are",
    "arent", "as", "at", "be", "because", "been", "before", "being", "below", "between", "both",
    "but", "by", "cant", "cannot", "could", "couldnt", "did", "didnt", "do", "does", "doesnt",
    "doing", "dont", "down", "during", "each", "few", "for", "from", "further", "had", "hadnt",
    "has", "hasnt", "have", "havent", "having", "he", "hed", "hell", "hes", "her", "here",
    "heres", "hers", "herself", "him", "himself", "his", "how", "hows", "i", "id", "ill", "im",
    "ive", "if", "in", "into", "is", "isnt", "it", "its", "itself", "lets", "me", "more",
    "most", "mustnt", "my", "myself", "no", "nor", "not", "of", "off", "on", "once", "only", "or",
    "other", "ought", "our", "ours", "ourselves", "out", "over", "own", "same", "shant", "she",
    "shed", "shell", "shes", "should", "shouldnt", "so", "some", "such", "than", "that",
    "thats", "the", "their", "theirs", "them", "themselves", "then", "there", "theres", "these",
    "they", "theyd", "theyll", "theyre", "theyve", "this", "those", "through", "to", "too",
    "under", "until", "up", "very", "was", "wasnt", "we", "wed", "well", "were", "weve",
    "were", "werent", "what", "whats", "when", "whens", "where", "wheres", "which", "while",
    "who", "whos", "whom", "why", "whys", "with", "wont", "would", "wouldnt", "you", "youd",
    "youll", "youre", "youve", "your", "yours", "yourself", "yourselves",
    "also", "just", "like", "one", "two", "three", "us", "get", "got", "may", "might", "much",
    "many", "still", "yet", "ever", "never", "say", "says", "said", "see", "seen", "go", "goes",
    "went", "come", "comes", "came", "make", "makes", "made", "know", "known", "thing", "things",
    "take", "taken", "put", "puts", "want", "wanted", "use", "used", "using", "back", "even",
    "well", "every", "everyone", "everything", "because", "however", "although", "though",
    "perhaps", "rather", "quite", "often", "always", "sometimes", "already", "too",
    "very", "else", "such", "within", "without", "across", "around", "behind", "beyond", "toward",
]
STOPWORDS = sorted(set(STOPWORDS_LISTED))

# Characters deleted before splitting into words: ASCII punctuation, then the digits.
PUNCTUATION_AND_DIGITS = string.punctuation + "1234567890"

# Characters that separate words (Python's str.split() whitespace set).
WHITESPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same set as a regular-expression class (used where a regex split is needed).
WHITESPACE_CLASS = (
    "[\\x{09}-\\x{0D}\\x{1C}-\\x{20}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}"
    "\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+"
)

# Emoji ranges stripped before language identification.
EMOJI_PATTERN = (
    "[\\x{1F300}-\\x{1F5FF}\\x{1F600}-\\x{1F64F}\\x{1F680}-\\x{1F6FF}\\x{1F900}-\\x{1F9FF}"
    "\\x{1FA70}-\\x{1FAFF}\\x{1FAE0}-\\x{1FAFF}\\x{2600}-\\x{26FF}\\x{2700}-\\x{27BF}"
    "\\x{1F1E6}-\\x{1F1FF}\\x{1F191}-\\x{1F251}\\x{1F004}\\x{1F0CF}\\x{1F170}-\\x{1F171}"
    "\\x{1F17E}-\\x{1F17F}\\x{1F18E}\\x{3030}\\x{2B50}\\x{2B55}\\x{2934}-\\x{2935}"
    "\\x{2B05}-\\x{2B07}\\x{2B1B}-\\x{2B1C}\\x{3297}\\x{3299}\\x{303D}\\x{A9}\\x{AE}\\x{2122}"
    "\\x{23F3}\\x{24C2}\\x{23E9}-\\x{23EF}\\x{25B6}\\x{23F8}-\\x{23FA}\\x{200D}\\x{FE0F}]+"
)

# Video link validation and key extraction.
VIDEO_LINK_PATTERN = (
    "^(http(s)?://)?(?:(www.|m.)?youtube.com/watch\\?v=|youtu.be/)[a-zA-Z0-9\\-_]{11}.*$"
)
# The key is the 11 characters after "v=" or "youtu.be/" (first such place).
VIDEO_KEY_PATTERN = "(?:v=|youtu\\.be/)([a-zA-Z0-9\\-_]{11})"

# Defaults of the analysed application.
MOST_LIKED_LIMIT = 5
COMMON_WORDS_LIMIT = 10
WORDCLOUD_TOP = 100
QUANTILES = [0.0, 0.25, 0.5, 0.75, 1.0]
LENGTH_HISTOGRAM_BINS = 450
DEFAULT_HISTOGRAM_BINS = 30
OUTLIER_K = 2.0
ALPHA = 0.05
SEQ_LEN_TRAIN = 40
SEQ_LEN_SEARCH = 50
