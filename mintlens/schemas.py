"""Schemas of the landed inputs (DDL strings, usable by readers and from_json)."""

from __future__ import annotations

# One landed block document per line. ``payload`` and ``logs`` arrive either as
# an object or as a JSON string; a STRING field receives both as JSON text.
TX_DDL = ("struct<contract:string,action:string,sender:string,transactionId:string,"
          "payload:string,logs:string>")
# ``ingestTs`` is stamped by the landing job (optional); it is the fallback
# block time and, unlike a file's modification time, survives re-copies.
BLOCK_DDL = f"blockNumber bigint, timestamp string, transactions array<{TX_DDL}>, ingestTs string"

# A transaction's logs: the emitted events, each event's data kept as JSON text.
EVENT_DDL = "struct<contract:string,event:string,data:string>"
LOGS_DDL = f"struct<events:array<{EVENT_DDL}>>"

# hitSellOrder data: sellers, each with the per-instance sales.
SELLERS_DDL = "array<struct<account:string,nftSales:array<map<string,string>>>>"

# Output rows.
NFT_EVENT_COLS = ["he_block", "tx_seq", "symbol", "nft_id", "op", "account", "counterparty",
                  "price", "price_symbol", "tx_id", "ts"]
SALE_COLS = ["symbol", "nft_id", "price", "price_symbol", "seller", "buyer", "he_block", "ts"]

# Landed snapshot records (catalog rows, holdings, sell orders): every field is
# read as text first and typed by the normalizers, so a node that sends a
# number as a string (or an object as a string) parses the same way.
CATALOG_RAW_DDL = ("symbol string, name string, orgName string, productName string, issuer string, "
                   "metadata string, groupBy string, properties string, delegationEnabled string, "
                   "marketEnabled string, supply string, circulatingSupply string, maxSupply string, "
                   "undelegationCooldown string, pos string")
HOLDING_RAW_DDL = ("symbol string, _id string, account string, ownedBy string, delegatedTo string, "
                   "delegatedToType string, soulbound string, soulBound string, properties string, fetchedAt string")
ORDER_RAW_DDL = ("symbol string, _id string, nftId string, account string, ownedBy string, price string, "
                 "priceSymbol string, fee string, timestamp string, grouping string, pos string, fetchedAt string")
# Fetch outcome per scope (account, symbol) or per symbol for books.
OUTCOME_DDL = "account string, symbol string, ok boolean, complete boolean, fetched_at timestamp"
