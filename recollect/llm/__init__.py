"""Training-data operators: scoring, licences, tokens, near-duplicates, packing, media.

Nothing outside this subpackage imports it.  Every operator takes a DataFrame
and returns one; none of them collects document-sized data to the driver.
"""
