"""Fixed values and the small configuration tables of the engine."""

from __future__ import annotations

# Token ids and limits that results must agree on.
PAD_ID = 0
BOS_ID = 1
EOS_ID = 2
NEWLINE_ID = 13
IGNORE_ID = -100
VOCAB_SIZE = 32000
MAX_EOS = 65
CHUNK_SIZE = 8192
BUFFER_SIZE = 4096
QUERY_TERMS = 300
BATCH_ROWS = 256
BATCHES_PER_DIR = 1024
SEED_CORPUS = 123
SEED_RETRIEVAL = 666
BM25_K1 = 1.2
BM25_B = 0.75

# Label names per classification task, by label id.
TASK_LABELS = {
    "agnews": ["world", "sports", "business", "science"],
    "amazon": ["negative", "positive"],
    "yelp": ["negative", "positive"],
    "sst2": ["positive", "negative"],
    "tweet_hate": ["Non-hate", "Hate"],
    "tweet_offensive": ["Non-hate", "Hate"],
    "dbpedia": [
        "Company", "EducationalInstitution", "Artist", "Athlete", "OfficeHolder", "MeanOfTransportation", "Building",
        "NaturalPlace", "Village", "Animal", "Plant", "Album", "Film", "WrittenWork",
    ],
}

# Sizes used when the operators run on the small test tables.
TEST_CHUNK = 256
TEST_BUFFER = 16
TEST_QUERY_TERMS = 32
