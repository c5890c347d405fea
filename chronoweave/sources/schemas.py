"""Declared schemas of the inputs; nothing is inferred."""

MENTION = "struct<id:string, trigger_word:string, sent_id:int, offset:array<int>>"
EVENT_DOCUMENT = (
    "id string, title string, tokens array<array<string>>, sentences array<string>,"
    f" events array<struct<id:string, type:string, type_id:int, mention:array<{MENTION}>>>,"
    " TIMEX array<struct<id:string, mention:string, type:string, sent_id:int, offset:array<int>>>,"
    " temporal_relations map<string, array<array<string>>>, causal_relations map<string, array<array<string>>>, subevent_relations string"
)
FILLER = "struct<entity_id:string, content:string, offset:array<int>>"
ARGUMENT_DOCUMENT = (
    "id string, entities array<struct<id:string, type:string, mention:array<struct<mention:string>>>>,"
    f" events array<struct<id:string, type:string, type_id:int, argument:map<string, array<{FILLER}>>>>"
)
MANIFEST = "rate double, n_changed int, changed array<struct<doc:string, event1:string, event2:string, fake:string>>"
RULES = "array<struct<view:string, sig:string, rel:string, conds:array<string>, wlb:double>>"
FEATURES = "split int, doc string, s string, t string, etype string, gold string, atoms string"
