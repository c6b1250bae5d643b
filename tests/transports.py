"""Providers for tests, named or pickled into Spark's workers; what they count is kept in files."""

import glob
import json
import os


def file_pages(page, options):
    """Pages of a file of JSON lines; each page fails `fails` times before it answers."""
    note = f"{options['notes']}/page-{page}"
    with open(note, "a") as f:
        f.write("x")
    if os.path.getsize(note) <= int(options.get("fails", 0)):
        raise ConnectionError("try again")
    rows = [json.loads(x) for x in open(options["file"])]
    size = int(options["page_size"])
    pages = -(-len(rows) // size) if options.get("known", "true") == "true" else None
    return {"records": rows[page * size : (page + 1) * size], "pages": pages}


def asked(folder):
    """How often each page was asked for."""
    return {os.path.basename(p): os.path.getsize(p) for p in glob.glob(f"{folder}/page-*")}


def counting(folder, answer):
    """A call that notes each prompt and answers by `answer`."""

    def call(prompt):
        with open(f"{folder}/asked-{abs(hash(prompt))}-{os.getpid()}", "a") as f:
            f.write(prompt.replace("\n", " ") + "\n")
        return answer(prompt)

    return call


def prompts(folder):
    return [line.strip() for p in glob.glob(f"{folder}/asked-*") for line in open(p)]
