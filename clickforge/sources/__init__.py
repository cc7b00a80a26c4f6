from clickforge.sources.tables import read_table, load_pair, sample_rows, dataset_check  # noqa: F401
from clickforge.sources.views import impressions, predictions, requests, split_train_test  # noqa: F401
