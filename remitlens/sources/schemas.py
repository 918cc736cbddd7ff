"""Schemas of the canonical inputs, as DDL text (usable before a session exists)."""

from __future__ import annotations

RAW_SNAPSHOT_ROW = (
    "ledger_sequence bigint, corridor string, source string, reliability double, volume double, latency_ms double"
)

PAYMENT = (
    "payment_id string, ts timestamp, ledger_sequence bigint, network string, source_account bigint, "
    "dest_account bigint, source_asset string, dest_asset string, corridor string, anchor string, asset string, "
    "amount_usd double, fee double, successful boolean, latency_ms double, slippage_bps double, failure_reason string"
)

# Every value keeps the kind its producer declared, because a wrong kind is an error of its own.
CONTRACT_EVENT = (
    "seq bigint, type string, contract_id string, topics array<struct<kind:string,value:string>>, data_kind string, "
    "data array<struct<key_kind:string,key:string,val_kind:string,val:string>>"
)

LOG = (
    "timestamp string, level string, message string, service string, target string, request_id string, "
    "http_method string, http_path string, http_status int, response_time_ms bigint, client_ip string, "
    "user_agent string, rpc_method string, query string, query_time_ms bigint, error struct<message:string>, "
    "password string, api_key string, secret string, token string, authorization string"
)

PAYMENT_PAGE = (
    "_embedded struct<records:array<struct<id:string,paging_token:string,transaction_successful:boolean,"
    "source_account:string,type:string,created_at:string,transaction_hash:string,asset_type:string,asset_code:string,"
    "asset_issuer:string,`from`:string,`to`:string,amount:string>>>"
)

TRADE_PAGE = (
    "_embedded struct<records:array<struct<id:string,paging_token:string,ledger_close_time:string,trade_type:string,"
    "base_account:string,base_amount:string,base_asset_type:string,base_asset_code:string,base_asset_issuer:string,"
    "counter_account:string,counter_amount:string,counter_asset_type:string,counter_asset_code:string,"
    "counter_asset_issuer:string,base_is_seller:boolean,price:struct<n:string,d:string>>>>"
)

ORDERBOOK = (
    "bids array<struct<price_r:struct<n:string,d:string>,price:string,amount:string>>, "
    "asks array<struct<price_r:struct<n:string,d:string>,price:string,amount:string>>, "
    "base struct<asset_type:string,asset_code:string,asset_issuer:string>, "
    "counter struct<asset_type:string,asset_code:string,asset_issuer:string>"
)
