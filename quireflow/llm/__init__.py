"""Training-data operators: ten document, vector and conversation operators.

Nothing outside this subpackage imports it; ``queries`` and ``oracles`` hold
what the driver registers.
"""
