"""Fixed values of the data model (they must match the published pipeline)."""

NO_DOMAIN = "<NO_DOMAIN>"     # stands for an invalid URL or a rare domain
MAX_VISITS = 8                # visits labelled per user = classes of the model
MAX_T = 32                    # events in a multi-visit window
VISIT_MAX_T = 5               # events in a single-visit window
URL_TOKENS = 10               # token positions averaged into a URL vector
VECTOR_SIZE = 100             # length of every embedding
URL_VECTOR = 2 * VECTOR_SIZE + 1
MIN_COUNT = 5                 # vocabulary threshold for tokens and domains
W2V_ITERATIONS = 8
MAX_USER_EVENTS = 800         # users need fewer events than this to be featurised
MAX_URL_LENGTH = 4096
BATCH_ROWS = 3 * 1024
VALIDATION_BATCH_ROWS = 8 * 1024
TRAIN_FRACTION = 0.3
TEST_PERCENT = 10

# Rows of one group that a single task is asked to sort; larger groups are split.
HOT_ROWS = 1_000_000
# Rows that a task sorts: this part of them, or this many where that is less.
HOT_PART = 4
TASK_ROWS = 25_000
# Up to this many counted keys are broadcast; more go through an ordinary join.
BROADCAST_KEYS = 100_000
# Rows per array when a per-user list is written out (also the sentence length
# at which Word2Vec cuts its input).
LIST_ROWS = 1000
# Numbers that one weight matrix of Spark ML's Word2Vec holds at most.
ML_WEIGHTS = (1 << 31) - 1
# Numbers of it that a driver is asked to hold; beyond, vectors come from co-occurrence counts.
DRIVER_WEIGHTS = 100_000_000
# Numbers that Word2Vec is asked to move, sightings of tokens x iterations x vector length; beyond, the same.
TRAINING_MOVES = 500_000_000
