"""Fixed schemas, file contracts and rule predicates of the behaviour and retail areas."""

from __future__ import annotations

from dataclasses import dataclass

#: Actions by their raw code, and their order in the funnel.
ACTIONS = {"0": "click", "1": "cart", "2": "buy", "3": "favorite"}
FUNNEL = {"click": 1, "cart": 2, "favorite": 3, "buy": 4}
EVENT_YEAR = 2014


@dataclass(frozen=True)
class FileSpec:
    """A raw file: its name, the table that it fills, and its header in order."""

    key: str
    file: str
    table: str
    header: tuple[str, ...]


FILES = (
    FileSpec("users", "user_info_format1.csv", "users", ("user_id", "age_range", "gender")),
    FileSpec("events", "user_log_format1.csv", "user_events", ("user_id", "item_id", "cat_id", "seller_id", "brand_id", "time_stamp", "action_type")),
    FileSpec("train", "train_format1.csv", "repurchase_samples", ("user_id", "merchant_id", "label")),
    FileSpec("test", "test_format1.csv", "repurchase_samples", ("user_id", "merchant_id", "prob")),
)

USERS = "user_id long, age_range short, gender short"
USER_EVENTS = "source_row_number long, user_id long, item_id long, category_id long, merchant_id long, brand_id long, event_date date, action_type string"
SAMPLES = "user_id long, merchant_id long, dataset_split string, label short, probability decimal(8,7)"
RUNS = "run_id long, seq long, file_name string, sha256 string, sample_modulus int, sample_residue int, status string, raw_row_count long, imported_row_count long, started_at timestamp, finished_at timestamp, error_category string, error_message string"

#: Columns that may be shown, by table of the retail star.
VISIBLE = {
    "customers": ("customer_id", "customer_name", "member_level", "registered_at"),
    "products": ("product_id", "product_name", "category_name", "unit_price"),
    "regions": ("region_id", "region_name", "region_level"),
    "date_dim": ("date_id", "full_date", "year", "quarter", "month", "month_name", "day_of_month", "week_of_year", "is_weekend"),
    "orders": ("order_no", "customer_id", "product_id", "region_id", "date_id", "quantity", "unit_price", "gross_amount", "discount_amount", "net_amount"),
}

#: Named rules that every row of a table satisfies, as SQL predicates.
RULES = {
    "user_events": {"known_action": "action_type in ('click', 'cart', 'buy', 'favorite')", "positive_row": "source_row_number > 0", "has_user": "user_id is not null and user_id >= 0"},
    "repurchase_samples": {
        "known_split": "dataset_split in ('train', 'test')",
        "train_has_label_only": "dataset_split <> 'train' or (label in (0, 1) and probability is null)",
        "test_has_no_label": "dataset_split <> 'test' or label is null",
        "probability_range": "probability is null or probability between 0 and 1",
    },
    "runs": {"known_status": "status in ('running', 'succeeded', 'failed')", "residue_range": "sample_modulus > 0 and sample_residue >= 0 and sample_residue < sample_modulus"},
    "funnel_metrics": {"known_step": "step_order between 1 and 4", "counts": "user_count >= 0 and event_count >= user_count"},
    "orders": {"net_is_gross_less_discount": "net_amount = gross_amount - discount_amount", "positive_quantity": "quantity > 0", "discount_range": "discount_amount >= 0 and discount_amount <= gross_amount"},
    "chunks": {"index_from_zero": "chunk_index >= 0", "counts": "char_count >= 0 and estimated_token_count >= 0", "hash_length": "length(content_hash) = 64"},
}
#: Unique keys by table.
KEYS = {"user_events": ("source_row_number",), "repurchase_samples": ("user_id", "merchant_id", "dataset_split"), "orders": ("order_no",), "chunks": ("source_file", "chunk_index"), "users": ("user_id",)}
