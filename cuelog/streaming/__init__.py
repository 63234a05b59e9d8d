"""Structured Streaming forms of the online operators, and their batch twins.

Order: a stateful operator sorts the rows of a key within one trigger by time
and sequence.  Rows that arrive in a later trigger come after, whatever their
time, as they would for a program watching the log.  Size a trigger with the
source's ``maxFilesPerTrigger``; it bounds what one key can bring at once.
"""
