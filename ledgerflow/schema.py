"""Schemas of the ledger tables."""

from __future__ import annotations

TRANSACTIONS = (
    "id long, statement_id long, txn_date date, value_date date, txn_time string, narration_raw string, debit decimal(18,2), credit decimal(18,2), "
    "balance decimal(18,2), balance_type string, reference string, txn_mode string, counterparty_name string, source_row int, quality_flag string, bank_json_data string"
)
#: What parsers give; files are the statements.
PARSED = "file_id string, " + TRANSACTIONS.removeprefix("id long, statement_id long, ")
ISSUES = (
    "issue_id string, statement_id long, transaction_id long, severity string, code string, message string, resolution_required boolean, suggested_action string, resolved boolean"
)
WORD_BOXES = "file_id string, page_no int, word_no int, text string, left double, top double, width double, height double, conf double, block_num int, par_num int, line_num int, page_width double"
CELLS = "file_id string, page_no int, table_no int, row_no int, cells array<string>"
TEXT_LINES = "file_id string, page_no int, line_no int, text string"

