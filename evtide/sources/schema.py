"""The schemas of nested extraction records, questions and answers, as Spark DDL."""

DATE = "struct<value:string,precision:string,text:string>"
MONEY = "struct<amount:double,currency:string,scale:string,text:string>"
COMPANY = "struct<name:string,normalized_name:string,ticker:string,exchange:string,cik:string,lei:string,country:string>"
DETAILS = (
    "struct<ma_event_subtype:string,deal_name:string,transaction_form:string,deal_status:string,consideration_type:string,strategic_rationale:string,"
    f"acquirers:array<{COMPANY}>,targets:array<{COMPANY}>,sellers:array<{COMPANY}>,deal_value:{MONEY},per_share_price:{MONEY},"
    f"announcement_date:{DATE},signing_date:{DATE},expected_closing_date:{DATE},closing_date:{DATE},"
    f"company:{COMPANY},person:struct<full_name:string,normalized_name:string>,action:string,departure_reason:string,appointment_source:string,prior_title:string,new_title:string,"
    f"effective_date:{DATE},departure_date:{DATE},appointment_date:{DATE},is_interim_or_acting:boolean,"
    f"issuer:{COMPANY},parent_company:{COMPANY},ipo_stage:string,offering_type:string,exchange:string,ticker:string,is_first_public_listing:boolean,is_spac_ipo:boolean,"
    f"pricing_date:{DATE},first_trading_date:{DATE},registration_filing_date:{DATE},offer_price:{MONEY},"
    f"split_type:string,ratio:struct<ratio_text:string,new_shares:double,old_shares:double,share_count_multiplier:double>,record_date:{DATE}>"
)
EVENT = (
    f"struct<event_type:string,event_date:{DATE},event_date_basis:string,event_status:string,headline_summary:string,duplicate_cluster_key_hint:string,"
    f"geography:array<string>,primary_companies:array<{COMPANY}>,source_article:struct<article_id:string,url:string>,details:{DETAILS}>"
)
EXTRACTION = f"article_id string, article_date string, title string, ok boolean, parsed_events_all array<{EVENT}>"
ANSWER = "struct<firm_ticker:string,event_type:string,anchor_date:string,role:string,counterparty_ticker:string,e1_anchor_date:string,e2_anchor_date:string,buyer_ticker:string,target_ticker:string,announce_date:string,close_date:string,days_between:int,bucket:string,cited_urls:array<string>>"
CHUNK = "struct<article_url:string,article_title:string,article_date:string,cited_sentence:string,days_to_event:int,judge:string,stage:string>"
