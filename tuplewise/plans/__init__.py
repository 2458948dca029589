"""From the syntax tree to one DataFrame: binding, checks and lowering."""
