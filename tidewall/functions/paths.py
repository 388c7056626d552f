"""Path policy as Columns. Real paths and symlinks are input columns; only the lexical part is computed."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewall.config import Policy
from tidewall.functions import let

#: Fixed values
SHELL_RC_FILES = [".bashrc", ".zshrc", ".profile", ".bash_profile", ".bash_login", ".zshenv", ".zprofile", ".zlogin", "config.fish", "fish_variables", ".inputrc"]
SCRIPT_EXTENSIONS = ["sh", "bash", "zsh", "dash", "ksh", "fish", "py", "pl", "rb", "js", "mjs"]
PERSISTENCE_MARKERS = [
    "/etc/profile.d/", "/.config/fish/", "/.config/systemd/user/", "/.local/share/systemd/user/", "/.config/autostart/",
    "/Library/LaunchAgents/", "/Library/LaunchDaemons/", "/.git/config", "/.git/hooks/",
]
WRITABLE_DIRS = ["/tmp/", "/var/tmp/", "/dev/shm/", "/private/tmp/", "/private/var/tmp/", "/var/folders/", "/private/var/folders/", "/run/user/"]
WRITABLE_HOME = ["Downloads", ".cache", "Library/Caches"]
HOME_DENY = [
    ".ssh", ".aws", ".gnupg", ".config/gh", ".netrc", ".docker/config.json", ".kube/config", ".git-credentials", ".config/git/credentials",
    ".npmrc", ".pypirc", ".cargo/credentials", ".cargo/credentials.toml",
]
SYSTEM_DENY = ["/etc/ssh", "/etc/shadow", "/etc/sudoers", "/etc/sudoers.d"]


def _trim(path: Column) -> Column:
    return F.regexp_replace(path, r"^(?U:\s+)|(?U:\s+)\z", "")


def _any(words: list[str]) -> str:
    return "(?:" + "|".join(re.escape(w) for w in words) + ")"


def normalize(path: Column) -> Column:
    """Lexical: no empty and dot segments, and each dot-dot takes a segment back."""

    def clean(p: Column) -> Column:
        parts = F.filter(F.split(p, "/", -1), lambda s: ~s.isin("", "."))
        none = F.array().cast("array<string>")
        kept = F.aggregate(parts, none, lambda out, s: F.when(s == "..", F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(F.concat(out, F.array(s))))
        return F.concat(F.when(p.startswith("/"), "/").otherwise(""), F.array_join(kept, "/"))

    return let(_trim(path), clean)


def expand_home(path: Column, home: str) -> Column:
    return F.when(path == "~", home).when(path.startswith("~"), F.concat(F.lit(home + "/"), F.regexp_replace(path, "^~/?", ""))).otherwise(path)


def _base(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def is_exec_target(path: Column) -> Column:
    """Whether a file of this name is likely to be run later."""

    def shaped(p: Column) -> Column:
        base = F.regexp_extract(p, r"(?s)([^/]*)/*\z", 1)
        # a start-up file, no extension, a trailing dot, or a script's extension
        names = rf"(?s)^(?:{_any(SHELL_RC_FILES)}|[^.]+|.+\.|.+\.(?i:{_any(SCRIPT_EXTENSIONS)}))\z"
        return ~p.rlike(r"^/dev(?:/|\z)") & base.rlike(names)

    return F.coalesce(let(_trim(path), shaped), F.lit(False))


def is_persistence_target(path: Column) -> Column:
    return F.coalesce(F.concat(F.regexp_replace(_trim(path), "/+$", ""), F.lit("/")).rlike(rf"(?s)(?:^|/){_any(SHELL_RC_FILES)}/\z|{_any(PERSISTENCE_MARKERS)}"), F.lit(False))


def in_writable_dir(path: Column, home: str) -> Column:
    dirs = [*WRITABLE_DIRS, *[f"{root}/{d}/" for d in WRITABLE_HOME for root in ("~", home.rstrip("/"))]]
    # file systems that ignore case are common
    return F.coalesce(F.lower(normalize(path)).rlike("^" + _any([d.lower() for d in dirs])), F.lit(False))


def grants_execute(mode: Column) -> Column:
    """A mode argument that sets an execute bit: u+x, a=rx, 755."""
    symbolic = F.exists(F.split(mode, ",", -1), lambda c: c.rlike(r"^[^-+=]*[+=].*[xX]"))
    octal = mode.rlike(r"^[0-7]{3,4}\z") & mode.rlike(r"[1357][0-7]{0,2}\z")
    return symbolic | octal


def is_dotenv(name: Column) -> Column:
    return ~name.isin(".env.example", ".env.sample", ".env.template") & (name.isin(".env", ".envrc") | name.startswith(".env."))


def _under(path: Column, rule: str) -> Column:
    return (path == rule) | path.startswith(rule + "/")


def denied_rule(path: Column, policy: Policy) -> Column:
    """The first deny rule that holds a path; null: none."""
    home = policy.home.rstrip("/")
    rules = [(f"{home}/{r}", None) for r in HOME_DENY] + [(SYSTEM_DENY[0], None), (".env", is_dotenv(_base(path)))]
    rules += [(r, None) for r in (*SYSTEM_DENY[1:], *policy.extra_deny)]
    out = F.lit(None).cast("string")
    for rule, test in reversed(rules):
        out = F.when(_under(path, rule) if test is None else test, rule).otherwise(out)
    return out


def read_verdict(path: Column, canonical: Column, has_symlink: Column, policy: Policy = Policy()) -> Column:  # noqa: B008
    """allow, deny_symlink or deny_rule: symlinks first, then the override, then rules and exact exceptions."""
    if policy.allow_sensitive:
        return F.when(has_symlink, "deny_symlink").otherwise("allow")
    hit = F.coalesce(denied_rule(canonical, policy), denied_rule(path, policy))
    excepted = path.isin(list(policy.allow_paths)) & (path == canonical) if policy.allow_paths else F.lit(False)
    return F.when(has_symlink, "deny_symlink").when(hit.isNull() | excepted, "allow").otherwise("deny_rule")
