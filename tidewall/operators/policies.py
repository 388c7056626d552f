"""The ordered command policies: Column predicates over the stages of one pipeline.

`POLICIES` lists (ordinal, name, predicate, reason); the first that holds decides. The recursive ordinals 8, 9,
13, 14 and 22 have their own rows (see functions/shell.py), so they judge nothing here but, for 9 and 14, the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewall.config import Policy
from tidewall.functions import let, paths, scan
from tidewall.functions.shell import CODE_SINKS, SHELLS

#: Fixed values
DOWNLOADERS = ["curl", "wget"]
EXFIL_TOOLS = [
    "curl", "wget", "nc", "ncat", "netcat", "socat", "dig", "host", "nslookup", "drill", "resolvectl", "scp", "rsync", "sftp", "ftp", "tftp",
    "aria2c", "lftp", "rclone", "gsutil", "aws", "az", "gcloud", "http", "https", "httpie", "xh", "mail", "sendmail", "mutt", "ssh",
]
MESSAGE_TOOLS = ["git", "gh", "glab", "jj"]
MESSAGE_FLAGS = ["-m", "--message", "-F", "--file"]
GIT_KEYS = [
    "core.pager", "core.editor", "core.hookspath", "core.fsmonitor", "core.sshcommand", "core.askpass", "core.gpgprogram", "gpg.program",
    "gpg.ssh.program", "gpg.x509.program", "protocol.ext.allow", "uploadpack.packobjectshook", "http.proxy", "https.proxy",
    "pack.packsizelimit", "credential.helper", "include.path",
]
GIT_COMMAND_VARS = ["GIT_SSH_COMMAND", "GIT_PROXY_COMMAND", "GIT_EDITOR", "GIT_PAGER", "GIT_ASKPASS", "GIT_EXTERNAL_DIFF"]
GIT_PLACE_VARS = ["GIT_DIR", "GIT_WORK_TREE", "GIT_CONFIG", "GIT_CONFIG_GLOBAL", "GIT_CONFIG_SYSTEM", "GIT_EXEC_PATH"]
SHELL_START_VARS = ["PROMPT_COMMAND", "BASH_ENV", "ENV", "ZDOTDIR"]
INSTALLERS = ["pip", "pip3", "pipx", "uv", "poetry"]
#: Interpreter names by the flags that take inline code
INLINE_CODE = {
    ("-c",): ["python", "python2", "python3", "python3.10", "python3.11", "python3.12", "python3.13", "python3.14", "guile"],
    ("-e", "-E"): ["perl", "julia"],
    ("-e", "-rubygems"): ["ruby"],
    ("-e", "-p", "--eval", "--print"): ["node", "nodejs", "deno", "bun"],
    ("-r",): ["php"],
    ("-c", "-Command", "-EncodedCommand"): ["pwsh", "powershell"],
    ("-e",): ["lua", "lua5.1", "lua5.2", "lua5.3", "lua5.4", "luajit", "tclsh", "rscript", "swift", "racket"],
    ("--eval",): ["sbcl"],
}
AWKS = ["awk", "gawk", "mawk", "nawk"]

Test = Callable[[Column], Column]


def _short(arg: Column, letters: str) -> Column:
    return arg.rlike(rf"^-[^-]*[{letters}]") & ~arg.startswith("--")


def _first(xs: Column) -> Column:
    return F.try_element_at(xs, F.lit(1))


def _followed_by(stages: Column, first: Test, later: Test) -> Column:
    """Some stage after the first that passes `first` passes `later`."""
    at = F.array_position(F.transform(stages, lambda s: F.coalesce(first(s), F.lit(False))), F.lit(True)).cast("int")
    return let(at, lambda at: (at > 0) & F.exists(F.slice(stages, at + 1, F.greatest(F.size(stages) - at, F.lit(0))), later))


def _arg_after(args: Column, flags: list[str]) -> Column:
    """The argument that follows the first of the flags."""
    at = F.array_position(F.transform(args, lambda a: a.isin(flags)), F.lit(True)).cast("int")
    return let(at, lambda at: F.when(at > 0, F.get(args, at)))


def _of(stage: Column, names: list[str]) -> Column:
    return stage["name"].isin(names)


def _is_net(stage: Column) -> Column:
    return _of(stage, EXFIL_TOOLS) | F.ltrim(stage["argv0"]).startswith("$")


def _is_decoder(s: Column) -> Column:
    def flag(letters: str, long: str) -> Column:
        return F.exists(s["args"], lambda a: _short(a, letters) | a.rlike(long))

    return (
        ((s["name"] == "base64") & flag("dD", "^--[dD]ec"))
        | ((s["name"] == "xxd") & flag("r", "^--rev"))
        | ((s["name"] == "openssl") & flag("dD", "^--[dD]ec"))
        | (s["name"] == "uudecode")
    )


def _stdout_target(s: Column) -> Column:
    """Where the stage's output goes at last."""
    return F.try_element_at(F.filter(s["redirects"], lambda r: (r["kind"] == "out") & r["fd"].isin("stdout", "both")), F.lit(-1))["target"]


def _named_output(s: Column) -> Column:
    attached = _first(F.filter(s["args"], lambda a: a.rlike("^(-o=|--out[^=]*=)")))
    uudecode = F.coalesce(F.regexp_replace(attached, "^[^=]*=", ""), _arg_after(s["args"], ["-o", "--output-file", "--output", "--out"]))
    return F.when(s["name"] == "tee", _first(F.filter(s["args"], lambda a: ~a.startswith("-")))).when(s["name"] == "uudecode", uudecode)


def _copy_target(s: Column) -> Column:
    args = s["args"]
    plain = F.filter(args, lambda a: ~a.startswith("-"))
    attached = F.regexp_replace(_first(F.filter(args, lambda a: a.startswith("--target-directory="))), "^[^=]*=", "")
    at = F.array_position(F.transform(args, lambda a: (a == "--target-directory") | a.rlike("^-[^-]*t$")), F.lit(True)).cast("int")
    last = F.try_element_at(plain, F.lit(-1))
    copied = F.coalesce(attached, F.when(at > 0, F.get(args, at)), F.when(F.size(plain) >= 2, last))
    in_place = F.exists(args, lambda a: a.startswith("--in-place") | _short(a, "i"))
    return (
        F.when(_of(s, ["cp", "mv", "install", "ln", "rsync"]), copied)
        .when(s["name"] == "dd", F.regexp_replace(_first(F.filter(args, lambda a: a.startswith("of="))), "^of=", ""))
        .when((s["name"] == "sed") & in_place, last)
    )


def _message_free(s: Column) -> Column:
    """Arguments without the text of commit messages."""
    state = F.struct(F.lit(False).alias("skip"), F.array().cast("array<string>").alias("kept"))

    def step(acc: Column, a: Column) -> Column:
        flag = a.isin(MESSAGE_FLAGS)
        keep = ~acc["skip"] & ~flag & ~a.rlike("^(--message=|-m=)")
        return F.struct((~acc["skip"] & flag).alias("skip"), F.when(keep, F.concat(acc["kept"], F.array(a))).otherwise(acc["kept"]).alias("kept"))

    return F.when(_of(s, MESSAGE_TOOLS), F.aggregate(s["args"], state, step, lambda acc: acc["kept"])).otherwise(s["args"])


def _tokens(s: Column) -> Column:
    return F.concat(F.array(s["argv0"]), s["args"], F.transform(s["redirects"], lambda r: r["target"]))


def _names_secret(stages: Column) -> Column:
    def in_stage(s: Column) -> Column:
        return F.exists(F.concat(F.array(s["argv0"]), _message_free(s), F.transform(s["redirects"], lambda r: r["target"])), scan.mentions_secret_path)

    return F.exists(stages, in_stage)


def _download_to_shell(st: Column, p: Policy) -> Column:
    return _followed_by(st, lambda s: _of(s, DOWNLOADERS), lambda s: _of(s, CODE_SINKS))


def _decode_to_exec(st: Column, p: Policy) -> Column:
    return F.exists(st, _is_decoder) & F.exists(st, lambda s: paths.is_exec_target(_stdout_target(s)) | paths.is_exec_target(_named_output(s)))


def _reverse_shell(st: Column, p: Policy) -> Column:
    return F.exists(st, lambda s: F.exists(_tokens(s), scan.opens_socket))


def _env_to_net(st: Column, p: Policy) -> Column:
    return _followed_by(st, lambda s: _of(s, scan.ENV_DUMPERS), _is_net)


def _secret_to_net(st: Column, p: Policy) -> Column:
    near = _names_secret(st) & F.exists(st, lambda s: _is_net(s) | (s["name"] == "git"))
    return near | _followed_by(st, lambda s: (s["name"] == "base64") & ~_is_decoder(s), _is_net)


def _across_substitution(st: Column, p: Policy) -> Column:
    subs = F.flatten(F.transform(st, lambda s: s["sub_names"]))
    net, sub_net = F.exists(st, lambda s: _of(s, EXFIL_TOOLS)), F.exists(subs, lambda n: n.isin(EXFIL_TOOLS))
    source = F.exists(st, lambda s: _of(s, [*scan.ENV_DUMPERS, "base64"]) | F.exists(s["args"], scan.mentions_secret_path)) | _names_secret(st)
    words = F.flatten(F.transform(st, lambda s: s["sub_words"]))
    sub_source = F.exists(subs, lambda n: n.isin([*scan.ENV_DUMPERS, "base64"])) | F.exists(words, scan.mentions_secret_path)
    return (net & sub_source) | (sub_net & source)


def _bad_text(text: Column, p: Policy) -> Column:
    staged = scan.mentions_network_tool(text, p.strict_quirks) & scan.mentions_shell_sink(text)
    return scan.looks_like_exfil(text, p.strict_quirks) | staged


def _staged_payload(st: Column, p: Policy) -> Column:
    def one(s: Column) -> Column:
        target = F.coalesce(_stdout_target(s), _named_output(s))
        bodies = F.transform(F.filter(s["redirects"], lambda r: r["kind"] == "heredoc"), lambda r: r["body"])
        text = F.array_join(F.concat(s["args"], bodies), " ")
        return _of(s, ["echo", "printf", "cat", "tee"]) & paths.is_exec_target(target) & let(text, lambda t: _bad_text(t, p))

    return F.exists(st, one)


def _persistence(st: Column, p: Policy) -> Column:
    return F.exists(st, lambda s: paths.is_persistence_target(_stdout_target(s)) | paths.is_persistence_target(_named_output(s)) | paths.is_persistence_target(_copy_target(s)))


def _stdin_script(st: Column, p: Policy) -> Column:
    at = F.array_position(F.transform(st, lambda s: _of(s, CODE_SINKS) & F.exists(s["args"], lambda a: _short(a, "s") & ~_short(a, "c"))), F.lit(True)).cast("int")
    bodies = lambda s: F.transform(F.filter(s["redirects"], lambda r: r["kind"].isin("heredoc", "herestring")), lambda r: F.coalesce(r["body"], r["target"]))
    text = lambda st: F.array_join(F.transform(st, lambda s: F.array_join(F.concat(F.array(s["argv0"]), s["args"], bodies(s)), " ")), "\n")
    return let(at, lambda at: (at > 1) & let(text(F.slice(st, 1, F.greatest(at - 1, F.lit(0)))), lambda t: _bad_text(t, p)))


def _shell_reads_net(st: Column, p: Policy) -> Column:
    return F.exists(st, lambda s: _of(s, CODE_SINKS) & F.exists(s["sub_all_names"], lambda n: n.isin(DOWNLOADERS)))


def _net_writes_shell(st: Column, p: Policy) -> Column:
    at = F.array_position(F.transform(st, lambda s: _of(s, DOWNLOADERS)), F.lit(True)).cast("int")
    sink = rf"^[<>]\(\s*(?:\S*/)?(?i:{'|'.join(x.replace('.', chr(92) + '.') for x in CODE_SINKS)})(?:\s.*)?\)\z"
    return let(at, lambda at: (at > 0) & F.exists(F.slice(st, F.greatest(at, F.lit(1)), F.size(st)), lambda s: F.exists(s["sub_all_names"], lambda n: n.isin(CODE_SINKS)) | F.exists(s["redirects"], lambda r: r["target"].rlike("(?s)" + sink))))


def _xargs_amplifier(st: Column, p: Policy) -> Column:
    def one(s: Column) -> Column:
        args = s["args"]
        attached = _first(F.filter(args, lambda a: a.rlike("^(-I.|--replace=)")))
        holder = F.coalesce(F.regexp_replace(attached, "^(-I|--replace=)", ""), _arg_after(args, ["-I"]), F.when(F.array_contains(args, "--replace"), F.lit("{}")))
        at = F.array_position(F.transform(args, lambda a: F.substring_index(a, "/", -1).isin(CODE_SINKS)), F.lit(True)).cast("int")
        rest = let(at, lambda at: F.slice(args, at + 1, F.greatest(F.size(args) - at, F.lit(0))))
        flag = F.array_position(F.transform(rest, lambda a: (a == "--command") | _short(a, "c")), F.lit(True)).cast("int")
        code = F.coalesce(F.when(flag > 0, F.get(rest, flag)), F.regexp_replace(_first(F.filter(rest, lambda a: a.startswith("-c="))), "^-c=", ""))
        bare = F.regexp_replace(F.trim(code), r"""^["']|["']$""", "")
        return (s["basename"] == "xargs") & holder.isNotNull() & (at > 0) & (bare == holder)

    return F.exists(st, lambda s: F.coalesce(one(s), F.lit(False)))


def _tar_text(st: Column, p: Policy) -> Column:
    value = r"^--(?:to-c|checkpoint-a)[a-z-]*=(?:exec=)?"
    return F.exists(st, lambda s: (s["name"] == "tar") & F.exists(s["args"], lambda a: a.rlike(value) & scan.looks_like_exfil(F.regexp_replace(a, value, ""), p.strict_quirks)))


def _vcs_install(st: Column, p: Policy) -> Column:
    def source(a: Column) -> Column:
        x = F.lower(a)
        return x.rlike(r"^(git|hg|svn|bzr)\+") | (x.rlike("^https?://") & x.rlike(r"(\.tar\.gz|\.tgz|\.zip|\.whl)$|#egg=")) | x.rlike("@ ?git\\+|@ http")

    return F.exists(st, lambda s: _of(s, INSTALLERS) & _first(F.filter(s["args"], lambda a: ~a.startswith("-"))).isin("install", "add") & F.exists(s["args"], source))


def _scheduler(st: Column, p: Policy) -> Column:
    def one(s: Column) -> Column:
        lists = F.exists(s["args"], lambda a: a.isin("-l", "--list")) & ~F.exists(s["args"], lambda a: a.isin("-", "-r", "-e", "--remove"))
        timer = F.exists(s["args"], lambda a: a.rlike("^--(on|timer)-"))
        return ((s["name"] == "crontab") & ~lists) | _of(s, ["at", "batch"]) | ((s["name"] == "systemd-run") & timer)

    return F.exists(st, one)


def _git_config(st: Column, p: Policy) -> Column:
    def one(s: Column) -> Column:
        args = s["args"]
        pairs = F.transform(args, lambda a, i: F.struct(F.when(i > 0, F.get(args, i - 1)).alias("before"), a.alias("a")))
        config = F.transform(
            F.filter(pairs, lambda x: (x["before"] == "-c") | x["a"].rlike(r"^(-c=|--config-env=)") | x["a"].rlike(r"^-c.*\..*=|^-c.*=.*\.")),
            lambda x: F.when(x["before"] == "-c", x["a"]).otherwise(F.regexp_replace(x["a"], "^(-c=?|--config-env=)", "")),
        )
        keys = "|".join(k.replace(".", r"\.") for k in GIT_KEYS)
        runs = F.exists(config, lambda c: c.rlike(rf"^(?i)(?:{keys})=") | c.rlike(r"^(?i)(?:submodule\..*\.update|includeif\..*\.path)=") | c.rlike(r"""^(?i)alias\.[^=]*=\s*['"]*!"""))
        env = F.exists(
            s["assignments"],
            lambda v: F.upper(v["name"]).isin(GIT_COMMAND_VARS)
            | (F.upper(v["name"]).isin(GIT_PLACE_VARS) & paths.in_writable_dir(F.regexp_replace(v["value"], r"""^(["'])(.*)\1$""", "$2"), p.home)),
        )
        pivot = F.exists(
            pairs,
            lambda x: (x["before"].isin("-C", "--git-dir", "--work-tree") & paths.in_writable_dir(x["a"], p.home))
            | (x["a"].rlike("^--(git-dir|work-tree)=") & paths.in_writable_dir(F.regexp_replace(x["a"], "^[^=]*=", ""), p.home)),
        )
        clone = F.array_contains(args, "clone") & F.exists(args, lambda a: a.startswith("ext::"))
        return (s["name"] == "git") & F.coalesce(runs | env | pivot | clone, F.lit(False))

    return F.exists(st, one)


def _shell_env(st: Column, p: Policy) -> Column:
    shell = F.exists(st, lambda s: _of(s, SHELLS) | F.exists(s["args"], lambda a: F.lower(F.substring_index(a, "/", -1)).isin(SHELLS)))
    return shell & F.exists(st, lambda s: F.exists(s["assignments"], lambda v: F.upper(v["name"]).isin(SHELL_START_VARS)))


def _glued_code(args: Column, flag: str) -> Column:
    """Code that is attached to its flag."""
    short = rf"""|^{flag}[^=].*["'(;$={{\[]""" if len(flag) == 2 else ""
    return F.regexp_replace(_first(F.filter(args, lambda a: a.rlike(rf"(?s)^{flag}={short}"))), rf"^{flag}=?", "")


def inline_code(s: Column) -> Column:
    """The program text that a scripting interpreter gets as an argument."""
    args, out = s["args"], None
    for flags, names in INLINE_CODE.items():
        code = F.coalesce(*[x for f in flags for x in (_arg_after(args, [f]), _glued_code(args, f))])
        out = F.when(_of(s, names), code) if out is None else out.when(_of(s, names), code)
    pairs = F.transform(args, lambda a, i: F.struct(F.when(i > 0, F.get(args, i - 1)).alias("before"), a.alias("a")))
    own = lambda x: x["a"].startswith("-") | (x["before"].isin("-v", "--assign") & x["a"].rlike(r"^\w+=")) | (x["before"].isin("-F", "--field-separator") & x["a"].rlike(r"""^[^(;{$"']{0,16}\z""")) | (x["before"].isin("-f", "--file") & x["a"].rlike(r"""^[^(;{"]*\z"""))
    program = F.transform(F.filter(pairs, lambda x: ~F.coalesce(own(x), F.lit(False))), lambda x: x["a"])
    return out.when(_of(s, AWKS) & (F.size(program) > 0), F.array_join(program, " "))


def _script_shellout(st: Column, p: Policy) -> Column:
    def one(s: Column) -> Column:
        return let(inline_code(s), suspicious)

    def suspicious(code: Column) -> Column:
        calls = scan.calls_subprocess(code)
        return scan.looks_like_exfil(code, p.strict_quirks) | (calls & (scan.mentions_network_tool(code, p.strict_quirks) | scan.is_obfuscated(code))) | scan.runs_downloader(code)

    return F.exists(st, lambda s: F.coalesce(one(s), F.lit(False)))


def _chmod_exec(st: Column, p: Policy) -> Column:
    def one(s: Column) -> Column:
        plain = F.filter(s["args"], lambda a: ~a.startswith("-"))
        return (s["name"] == "chmod") & F.exists(plain, paths.grants_execute) & F.exists(plain, lambda a: ~paths.grants_execute(a) & paths.in_writable_dir(a, p.home))

    return F.exists(st, one)


def _git_denied(st: Column, p: Policy) -> Column:
    return F.lit(p.git_hard_deny) & F.exists(st, lambda s: s["name"] == "git")


#: In the order in which they decide
POLICIES: list[tuple[int, str, Callable[[Column, Policy], Column], str]] = [
    (0, "download_to_shell", _download_to_shell, "a download is piped to a shell"),
    (1, "decode_to_exec", _decode_to_exec, "decoded data is written to a file that will be run"),
    (2, "reverse_shell", _reverse_shell, "a socket device is used"),
    (3, "env_to_network", _env_to_net, "the environment is piped to a network tool"),
    (4, "secret_to_network", _secret_to_net, "a credential path or encoded data goes to a network tool"),
    (5, "substitution_exfil", _across_substitution, "a secret reaches a network tool through a substitution"),
    (6, "staged_payload", _staged_payload, "a payload is written to a file that will be run"),
    (7, "persistence_write", _persistence, "a start-up or persistence path is written"),
    (9, "stdin_script", _stdin_script, "a shell reads a suspicious script from a pipe"),
    (10, "shell_reads_network", _shell_reads_net, "a shell runs what a substitution downloads"),
    (11, "network_writes_shell", _net_writes_shell, "a download goes to a shell in a substitution"),
    (12, "xargs_amplifier", _xargs_amplifier, "xargs makes commands of its input"),
    (14, "tar_command", _tar_text, "tar runs a suspicious command"),
    (15, "vcs_install", _vcs_install, "a package is installed from a repository or a bare URL"),
    (16, "scheduler", _scheduler, "a command is scheduled for later"),
    (17, "git_config_injection", _git_config, "git is made to run a configured command"),
    (18, "shell_env_injection", _shell_env, "a shell start-up variable is set"),
    (19, "script_shellout", _script_shellout, "inline code of an interpreter spawns a download or leaks a secret"),
    (20, "chmod_exec", _chmod_exec, "a file in a writable directory is made executable"),
    (21, "git_hard_deny", _git_denied, "git is denied by the settings"),
]

#: Names of ordinals that judge an inner script
RECURSIVE = {"here_body": 8, "stdin": 9, "rsync_rsh": 13, "tar_exec": 14, "unwrap": 22, "subst": 23}
