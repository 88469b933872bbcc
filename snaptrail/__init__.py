"""Jobs for registers that are published again and again: read, type, identify, check, keep history, ask."""
