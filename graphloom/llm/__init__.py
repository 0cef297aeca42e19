"""Training-data operators: filters, de-duplication, archives, tokens, shards.

Nothing outside this folder imports it; ``queries`` lists what the entry module registers.
"""
