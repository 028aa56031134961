"""Training-data operators (decontamination, chat formatting, PII, dedup, packing, ...).

Nothing outside this subpackage imports it; ``queries`` lists what it registers.
"""
